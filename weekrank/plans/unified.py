"""Events joined to all metadata and labels in one wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekrank import schemas, session
from weekrank.operators import columns, joins, weekly

NAME_COLUMNS = ("artist_name", "track_name", "album_name")


def unify(events: DataFrame, *, artists: DataFrame | None = None, tracks: DataFrame | None = None,
          albums: DataFrame | None = None, artist_metadata: DataFrame | None = None,
          catalog: DataFrame | None = None, favorites: DataFrame | None = None,
          event_id: Sequence[str] = ("scrobble_number",)) -> DataFrame:
    """One row per event with week, canonical keys, metadata and label; the row count never changes.

    The metadata joins do not touch the events: they run on the distinct name combinations, which are
    far fewer, and only the finished name table is joined to the events. The events are shuffled at
    most twice (names, labels), whatever the number of metadata sources, and the canonical keys are
    computed once per distinct name. Earlier sources win where two have the same column.
    """
    event_columns = events.columns
    names = columns.present(events, [*NAME_COLUMNS, "artist_mbid"])
    # Stored: the joins, their key counts and the final join all read it.
    combos = session.cut(joins.name_keys(events, names))
    meta_key = ["artist_key"]
    if artist_metadata is not None and "artist_name" not in artist_metadata.columns:
        meta_key = ["artist_mbid"]
    sources = [
        (artists, ["artist_key"]), (tracks, ["artist_key", "track_key"]), (albums, ["artist_key", "album_key"]),
        (artist_metadata, meta_key), (catalog, ["artist_key", "track_key"]),
    ]
    taken = {c for c in event_columns if c not in names}
    wide = combos
    orders = []
    for table, on in sources:
        if table is None:
            continue
        keyed = joins.with_keys(table)
        orders.append([c for c in keyed.columns if c not in event_columns])
        # A column the events carry themselves is not taken from metadata.
        keyed = keyed.drop(*[c for c in keyed.columns if c in taken and c not in on])
        wide = joins.attach(wide, keyed, on, spread_by=names, counts=joins.key_counts(combos, on))
    anchored = weekly.anchor_week(events)
    out = joins.spread_join(anchored, wide, names, spread_by=event_id, counts=combos.select(*names, "n"), weight="n",
                            null_safe=True)
    if favorites is not None:
        # Stored, so that their size is known. Labels are few; should they outgrow a broadcast, the weeks
        # of each name are counted on the events.
        keyed = session.cut(joins.by_distinct(favorites, list(schemas.ENTITY), joins.with_keys))
        key = ["artist_key", "track_key", schemas.WEEK]
        counts = None
        if not session.fits_broadcast(keyed):
            per_week = joins.key_counts(anchored, [*names, schemas.WEEK]).withColumnRenamed("n", "_rows")
            keys = [c for c in ("artist_key", "track_key") if c in combos.columns]
            matched = per_week.join(combos.select(*[F.col(c).alias(f"_c_{c}") for c in names], *keys),
                                    joins.same([(c, f"_c_{c}") for c in names]))
            counts = matched.groupBy(*key).agg(F.sum("_rows").alias("n"))
        out = joins.attach_labels(out, keyed, key, spread_by=event_id, counts=counts)
    return columns.order_columns(out, event_columns, *orders, tail=[schemas.WEEK, "added_at_utc", schemas.LABEL])
