"""Table schemas, column lists and lookup values of the listening-history data model."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _d, _i = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
_ts, _date = T.TimestampType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# --- Fixed values: table and column names users of the data model rely on -----------------------

ENTITY = ("artist_name", "track_name")
WEEK = "week_saturday_utc"
WEEK_TS = "week_saturday_dt"
LABEL = "is_week_favorite"
LABEL_START = "2021-01-02"

SCROBBLES = _struct(
    ("scrobble_number", _l), ("username", _s), ("track_name", _s), ("track_mbid", _s), ("date", _ts),
    ("artist_name", _s), ("artist_mbid", _s), ("album_name", _s), ("album_mbid", _s),
)
ARTISTS = _struct(("artist_name", _s), ("artist_listeners", _l), ("artist_playcount", _l))
TRACKS = _struct(("artist_name", _s), ("track_name", _s), ("track_duration", _l))
ALBUMS = _struct(("artist_name", _s), ("album_name", _s), ("album_listeners", _l), ("album_playcount", _l))
ARTIST_METADATA = _struct(
    ("artist_mbid", _s), ("mb_artist_country", _s), ("mb_artist_type", _s), ("mb_artist_main_genre", _s),
    ("mb_artist_career_begin", _s), ("mb_artist_career_end", _s), ("mb_artist_career_ended", _d),
)
CATALOG_TRACKS = _struct(
    ("artist_name", _s), ("track_name", _s), ("spotify_track_id", _s), ("spotify_album", _s),
    ("spotify_release_date", _s), ("spotify_duration_ms", _l), ("spotify_popularity", _l), ("spotify_genres", _s),
)
FAVORITES = _struct(
    ("artist_name", _s), ("track_name", _s), ("spotify_track_id", _s), ("added_at_utc", _ts),
    (WEEK, _date), (LABEL, _i),
)

INPUT_TABLES = {
    "scrobbles": SCROBBLES, "artists": ARTISTS, "tracks": TRACKS, "albums": ALBUMS,
    "artist_metadata": ARTIST_METADATA, "catalog_tracks": CATALOG_TRACKS, "favorites": FAVORITES,
}

TEXT_COLUMNS = ["artist_name", "track_name", "album_name", "username", "spotify_album"]
DATE_COLUMNS = ["date", "added_at_utc", WEEK, "spotify_release_date"]
NUMERIC_COLUMNS = [
    "track_duration", "artist_listeners", "artist_playcount", "album_listeners", "album_playcount",
    "spotify_popularity",
]
MEDIAN_COLUMNS = ["artist_listeners", "artist_playcount", "album_listeners", "album_playcount", "spotify_popularity"]
COUNT_COLUMNS = ["artist_listeners", "artist_playcount", "album_listeners", "album_playcount"]
UNUSED_COLUMNS = ["spotify_duration_ms"]

CARRIED_COLUMNS = [
    "track_mbid", "artist_mbid", "album_mbid", "track_key", "artist_key", "album_key", "spotify_track_id",
    "track_duration", "spotify_release_date", "release_date_granularity", "spotify_genres", "genre_bucket",
    "genre_missing", "spotify_popularity", "artist_listeners", "artist_playcount", "album_listeners",
    "album_playcount", "date_was_missing", "added_at_utc_was_missing", "week_saturday_utc_was_missing",
    "spotify_release_date_was_missing", "artist_listeners_was_missing", "artist_playcount_was_missing",
    "album_listeners_was_missing", "album_playcount_was_missing", "spotify_popularity_was_missing",
]
LEAKY_COLUMNS = ["artist_listeners", "artist_playcount", "album_listeners", "album_playcount"]
IDENTIFIER_COLUMNS = [
    "artist_name", "track_name", WEEK, WEEK_TS, "track_mbid", "artist_mbid", "album_mbid", "track_key",
    "artist_key", "album_key", "spotify_track_id",
]
REDUNDANT_COLUMNS = ["prior_weeks_with_scrobbles", "weeks_since_first_scrobble"]
CORE_FEATURES = [
    "spotify_popularity", "track_duration", "scrobbles_week", "unique_days_week", "scrobbles_last_fri_sat",
    "scrobbles_saturday", "last_scrobble_gap_days", "within_week_rank_by_scrobbles", "scrobbles_prev_1w",
    "scrobbles_prev_4w", "week_over_week_change", "momentum_4w_ratio", "prior_scrobbles_all_time",
    "first_seen_week", "days_since_release",
]

# Cells a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Ordered substring rules from a genre to its bucket (first hit wins, no hit = other).
GENRE_BUCKETS = [
    ("hip_hop_rap", ["hip hop", "rap", "trap", "drill", "boom bap", "g-funk", "grime"]),
    ("rnb_soul", ["r&b", "rnb", "soul", "motown", "new jack swing", "neo soul", "philly soul"]),
    ("electronic_dance", [
        "edm", "house", "techno", "trance", "disco", "vaporwave", "ambient", "downtempo", "future house",
        "future bass", "progressive house", "slap house", "garage", "chillstep", "chillwave", "psytrance",
        "moombahton", "big room", "eurodance", "italo disco", "jersey club", "nightcore", "stutter house",
        "disco house", "dubstep", "electroclash"]),
    ("jazz", [
        "jazz", "bebop", "hard bop", "fusion", "vocal jazz", "nu jazz", "cool jazz", "free jazz", "jazz funk",
        "jazz house", "jazz blues", "jazz beats"]),
    ("classical_art", [
        "classical", "chamber", "opera", "neoclassical", "minimalism", "baroque", "soundtrack", "musicals",
        "orchestral"]),
    ("folk_country_americana", ["folk", "bluegrass", "americana", "singer-songwriter", "country", "alt country"]),
    ("metal_hard", [
        "metal", "hardcore", "thrash", "grindcore", "sludge", "stoner", "post-hardcore", "metalcore",
        "gothic metal", "power metal", "black metal", "nu metal", "melodic death"]),
    ("rock", [
        "rock", "shoegaze", "post-rock", "post-punk", "proto-punk", "new wave", "glam rock", "progressive rock",
        "math rock", "indie rock", "garage rock", "hard rock", "space rock", "grunge", "power pop", "yacht rock",
        "classic rock", "art rock", "riot grrrl", "punk", "surf rock", "rap rock", "krautrock"]),
    ("pop", [
        " pop", "synthpop", "hyperpop", "art pop", "bedroom pop", "indie pop", "dance pop", "power pop",
        "pop punk", "britpop", "city pop", "soft pop"]),
    ("latin", [
        "latin", "mpb", "bossa nova", "samba", "cumbia", "reggaeton", "salsa", "bachata", "bolero", "sertanejo",
        "pagode", "tecnobrega", "neoperreo", "calypso", "forro", "forró"]),
    ("world_regional", [
        "fado", "flamenco", "afrobeat", "afrobeats", "highlife", "gnawa", "k-pop", "kpop", "k-rap", "k rap",
        "k-rock", "k rock", "j-pop", "jpop", "j-rap", "j rap", "j-rock", "j rock", "j-r&b", "mandopop", "celtic",
        "mariachi", "kizomba", "kuduro", "bhangra", "pagode baiano", "sertanejo", "funk carioca",
        "brazilian funk", "brazilian hip hop", "turkish hip hop", "german hip hop", "french rap"]),
    ("experimental_avant", ["experimental", "avant", "noise", "idm", "drone", "witch house", "psych", "post-"]),
]

# Where a credited artist name is cut, tried in this order.
CREDIT_CUTS = [r"\sfeat\.", r"\sFeat\.", r"\sft\.", r"\sFt\.", r"\s\[", r"\sX\s"]

# Title corrections, applied in order as (columns to match, columns to set).
TITLE_FIXES = [
    ({"track_name": "Mysterons - Live"}, {"track_name": "Mysterons (Live)"}),
    ({"track_name": "Phoenix"}, {"track_name": "Phoenix (feat. Fleet Foxes & Anaïs Mitchell)"}),
    ({"track_name": "Bonita Applebum"}, {"track_name": "Bonita Applebum - includes 'Can I Kick It' Intro"}),
    ({"track_name": "Pronto"}, {"track_name": "Careless"}),
    ({"track_name": "Love More", "artist_name": "Fiona Apple"},
     {"track_name": "Love More (By Fiona Apple)", "artist_name": "Sharon Van Etten"}),
]

# Bin edges of the lift tables.
LIFT_BINS = {
    "scrobbles_week": [0, 1, 3, 6, 10, 15, 20, 25, float("inf")],
    "scrobbles_last_fri_sat": [0, 1, 3, 5, 7, 10, 14, float("inf")],
    "scrobbles_saturday": [0, 1, 3, 5, 7, 10, float("inf")],
    "within_week_rank_by_scrobbles": [1, 2, 3, 5, 7, 10, float("inf")],
    "momentum_4w_ratio": [0, 0.25, 0.5, 0.75, 1, 1.5, 2, 3, 5, float("inf")],
    "prior_scrobbles_all_time": [0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, float("inf")],
    "days_since_release": [float("-inf"), 3, 7, 14, 30, 60, 90, 180, 365, float("inf")],
}

# --- Landed JSON payloads -----------------------------------------------------------------------

_text_ref = _struct(("#text", _s), ("mbid", _s))
HISTORY_PAGE = _struct(("recenttracks", _struct(("track", T.ArrayType(_struct(
    ("name", _s), ("mbid", _s), ("artist", _text_ref), ("album", _text_ref), ("date", _struct(("#text", _s))),
    ("@attr", _struct(("nowplaying", _s))),
))))))
TRACK_INFO = _struct(("track", _struct(("duration", _s))))
ALBUM_INFO = _struct(("album", _struct(("listeners", _s), ("playcount", _s))))
ARTIST_INFO = _struct(("artist", _struct(("stats", _struct(("listeners", _s), ("playcount", _s))))))
USER_PROFILE = _struct(("user", _struct(
    ("name", _s), ("playcount", _s), ("artist_count", _s), ("album_count", _s), ("track_count", _s),
    ("image", T.ArrayType(_struct(("size", _s), ("#text", _s)))), ("country", _s),
)))
ARTIST_DETAILS = _struct(
    ("tags", T.ArrayType(_struct(("name", _s), ("count", _l)))), ("country", _s),
    ("area", _struct(("iso-3166-1-codes", T.ArrayType(_s)))),
    ("life-span", _struct(("begin", _s), ("end", _s), ("ended", T.BooleanType()))), ("type", _s),
)
PLAYLIST_PAGE = _struct(("items", T.ArrayType(_struct(
    ("added_at", _s),
    ("track", _struct(("id", _s), ("name", _s), ("artists", T.ArrayType(_struct(("name", _s)))))),
))))
CATALOG_TRACK = _struct(
    ("id", _s), ("popularity", _l), ("duration_ms", _l), ("album", _struct(("name", _s), ("release_date", _s))),
    ("artists", T.ArrayType(_struct(("id", _s), ("name", _s)))),
)
CATALOG_ARTIST = _struct(("id", _s), ("genres", T.ArrayType(_s)))
