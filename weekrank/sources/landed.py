"""Landed JSON payloads to rows. Each function takes a table with the payload text in one column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank import schemas
from weekrank.functions import dates, nested
from weekrank.functions.numbers import bool_as_double
from weekrank.operators import joins, ordered
from weekrank.operators.columns import apply_fixes, between_times


def _parsed(df: DataFrame, schema, payload: str) -> DataFrame:
    """The parsed payload in `_d`; null where the text is no such JSON."""
    return df.withColumn("_d", F.from_json(F.col(payload), schema))


def _text(c):
    return F.coalesce(c, F.lit(""))


def history_rows(pages: DataFrame, username: str, payload: str = "payload", after=None, until=None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Play events of landed history pages: running plays and undated ones dropped, (after, until] kept."""
    item = _parsed(pages, schemas.HISTORY_PAGE, payload).select(*keep, F.explode("_d.recenttracks.track").alias("t"))
    playing = F.col("t.`@attr`.nowplaying").eqNullSafe("true")
    at = dates.parse_display(F.col("t.date.`#text`"))
    rows = item.filter(~playing).select(
        *keep, F.lit(username).alias("username"), _text(F.col("t.name")).alias("track_name"),
        _text(F.col("t.mbid")).alias("track_mbid"), at.alias("date"),
        _text(F.col("t.artist.`#text`")).alias("artist_name"), _text(F.col("t.artist.mbid")).alias("artist_mbid"),
        _text(F.col("t.album.`#text`")).alias("album_name"), _text(F.col("t.album.mbid")).alias("album_mbid"),
    ).filter(F.col("date").isNotNull())
    return between_times(rows, F.col("date"), after, until)


def scrobbles(pages: DataFrame, username: str, start: int = 0, payload: str = "payload", after=None,
              until=None) -> DataFrame:
    """History rows numbered in time order from start + 1."""
    rows = history_rows(pages, username, payload, after, until)
    order = ["date", "track_name", "artist_name", "album_name", "track_mbid", "artist_mbid", "album_mbid"]
    return ordered.running_number(rows, order, "scrobble_number", start).select(*schemas.SCROBBLES.names)


def track_info(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Track duration in whole seconds, 0 when unknown."""
    seconds = F.floor(nested.count_or_zero(F.col("_d.track.duration")) / F.lit(1000)).cast("long")
    return _parsed(df, schemas.TRACK_INFO, payload).select("artist_name", "track_name", seconds.alias("track_duration"))


def album_info(df: DataFrame, payload: str = "payload") -> DataFrame:
    return _parsed(df, schemas.ALBUM_INFO, payload).select(
        "artist_name", "album_name", nested.count_or_zero(F.col("_d.album.listeners")).alias("album_listeners"),
        nested.count_or_zero(F.col("_d.album.playcount")).alias("album_playcount"))


def artist_info(df: DataFrame, payload: str = "payload") -> DataFrame:
    return _parsed(df, schemas.ARTIST_INFO, payload).select(
        "artist_name", nested.count_or_zero(F.col("_d.artist.stats.listeners")).alias("artist_listeners"),
        nested.count_or_zero(F.col("_d.artist.stats.playcount")).alias("artist_playcount"))


def user_profile(df: DataFrame, payload: str = "payload", image_size: str = "extralarge") -> DataFrame:
    user = F.col("_d.user")
    return _parsed(df, schemas.USER_PROFILE, payload).filter(user.isNotNull()).select(
        user["name"].alias("username"), user["playcount"].try_cast("bigint").alias("user_playcount"),
        user["artist_count"].try_cast("bigint").alias("user_artist_count"),
        user["album_count"].try_cast("bigint").alias("user_album_count"),
        user["track_count"].try_cast("bigint").alias("user_track_count"),
        nested.text_of(user["image"], "size", image_size).alias("user_image"), user["country"].alias("user_country"))


def artist_details(df: DataFrame, countries: DataFrame | None = None, payload: str = "payload") -> DataFrame:
    """Artist facts: country name, type, top tag, career span; gaps as empty text."""
    table = joins.iso_countries(df.sparkSession) if countries is None else countries
    area_code = nested.first_item(F.col("_d.area.`iso-3166-1-codes`"))
    code = F.coalesce(F.nullif(area_code, F.lit("")), F.col("_d.country"))
    named = joins.with_lookup(_parsed(df, schemas.ARTIST_DETAILS, payload), code, table, "country", "_country")
    span = "_d.`life-span`"
    return named.select(
        "artist_mbid", F.col("_country").alias("mb_artist_country"), _text(F.col("_d.type")).alias("mb_artist_type"),
        _text(nested.top_by_count(F.col("_d.tags"))).alias("mb_artist_main_genre"),
        _text(dates.normalise_partial(F.col(f"{span}.begin"))).alias("mb_artist_career_begin"),
        _text(dates.normalise_partial(F.col(f"{span}.end"))).alias("mb_artist_career_end"),
        bool_as_double(F.col(f"{span}.ended")).alias("mb_artist_career_ended"))


def catalog_tracks(df: DataFrame, artists: DataFrame | None = None, payload: str = "payload",
                   artist_payload: str = "payload") -> DataFrame:
    """Catalog facts of matched tracks, with the first genre of the first artist; unmatched rows drop out."""
    track = F.col("_d")
    first = nested.first_item(F.col("_d.artists"))["id"]
    rows = _parsed(df, schemas.CATALOG_TRACK, payload).filter(F.col("_d.id").isNotNull()).select(
        "artist_name", "track_name", track["id"].alias("spotify_track_id"),
        F.col("_d.album.name").alias("spotify_album"), F.col("_d.album.release_date").alias("spotify_release_date"),
        track["duration_ms"].alias("spotify_duration_ms"), track["popularity"].alias("spotify_popularity"),
        first.alias("_artist_id"))
    if artists is None:
        return rows.withColumn("spotify_genres", F.lit(None).cast("string")).drop("_artist_id")
    genres = _parsed(artists, schemas.CATALOG_ARTIST, artist_payload).filter("_d.id is not null").groupBy(
        F.col("_d.id").alias("_artist_id")).agg(F.min(nested.first_item(F.col("_d.genres"))).alias("spotify_genres"))
    joined = joins.lookup(rows, genres, ["_artist_id"], spread_by=["spotify_track_id"])
    return joined.select(*schemas.CATALOG_TRACKS.names)


def favorites(pages: DataFrame, payload: str = "payload", fixes=schemas.TITLE_FIXES) -> DataFrame:
    """Labelled picks of landed playlist pages, each with the Saturday it stands for."""
    item = _parsed(pages, schemas.PLAYLIST_PAGE, payload).select(F.explode("_d.items").alias("i")).filter(
        F.col("i.track").isNotNull())
    rows = item.select(
        nested.first_item(F.col("i.track.artists"))["name"].alias("artist_name"), F.col("i.track.name").alias("track_name"),
        F.col("i.track.id").alias("spotify_track_id"), dates.parse_text(F.col("i.added_at")).alias("added_at_utc"))
    named = apply_fixes(rows, fixes)
    return named.select(*rows.columns, dates.nearest_saturday(F.col("added_at_utc")).alias(schemas.WEEK),
                        F.lit(1).cast("int").alias(schemas.LABEL))
