"""History of changing attributes as insert-only satellites.

A satellite holds the attributes of a key that change at one rate. A row is
appended only where its hash-diff differs from the row before it; a row without
a diff marks an absence. End dates are not stored: ``satellite_view`` computes
them with ``lead``.

Two loaders find the changes:

* ``interval_changes`` for a log of updates with business periods, where on
  each day the covering row recorded last holds; its one attribute, the mapping,
  goes through one satellite by day;
* ``load_snapshots`` for full snapshots by revision. Mapping and descriptive
  names change at different rates, so there are two satellites: the mapping's
  records that a key is present or absent, the names' what it was called while
  present. A later batch of snapshots appends to what is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silverbarn.session import cut_lineage

#: Days are counted from 0001-01-01 so that every date up to 9999-12-31 fits
#: into DAY_BITS bits; the ends of the axis stand for unbounded sides.
DAY_ZERO = "0001-01-01"
DAY_BITS = 22
FIRST_DAY = -1
LAST_DAY = 2**DAY_BITS - 2

#: Keys with more distinct updates than this go through the dyadic index.
HOT_ROWS = 48


def lenient_day(text: Column) -> Column:
    """The day of a date or date-time written year, month, day.

    Separators may be ``-``, ``/``, ``.``, a blank or none; a time after the
    day is ignored. Null, blank and unreadable text give null.
    """
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{4})[-/. ]?(\d{1,2})[-/. ]?(\d{1,2})(?!\d)", i)
    return F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")


def _axis(day: Column) -> Column:
    return F.datediff(day, F.lit(DAY_ZERO).cast("date"))


def _shown(axis: Column) -> Column:
    inner = F.date_format(F.date_add(F.lit(DAY_ZERO).cast("date"), axis.cast("int")), "yyyy-MM-dd")
    return F.when(axis.isNull() | (axis <= FIRST_DAY) | (axis >= LAST_DAY), F.lit("")).otherwise(inner)


def satellite(changes: DataFrame, key: list[str], order: str, diff: str) -> DataFrame:
    """Appends only: keeps the rows whose hash-diff differs from the one before.

    ``changes`` holds at most one row per key and ``order``.
    """
    before = F.lag(F.struct(diff)).over(W.partitionBy(*key).orderBy(order))
    return changes.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col(f"_before.{diff}").eqNullSafe(F.col(diff))).drop("_before")


def satellite_view(rows: DataFrame, key: list[str], order: str, diff: str, end: str) -> DataFrame:
    """Adds the end of every version as the ``order`` of the next row; rows that only mark an absence go."""
    return rows.withColumn(end, F.lead(order).over(W.partitionBy(*key).orderBy(order))).where(F.col(diff).isNotNull())


def _dyadic_cover(start: Column, end: Column) -> Column:
    """The aligned blocks (level, index) whose disjoint union is [start, end).

    Per level at most one block on the left and one on the right edge, so at
    most 2 * DAY_BITS blocks whatever the length.
    """
    blocks = []
    for level in range(DAY_BITS + 1):
        size = 1 << level
        # the part of [start, end) left over by smaller blocks is [up, down)
        up = F.ceil(start / size).cast("long")
        down = F.floor(end / size).cast("long")
        fits = up < down
        # a block is used on this level if its parent does not fit
        left = F.when(fits & (up % 2 == 1), F.struct(F.lit(level).alias("level"), up.alias("index")))
        right = F.when(fits & (down % 2 == 1) & ~((up % 2 == 1) & (up == down - 1)), F.struct(F.lit(level).alias("level"), (down - 1).alias("index")))
        blocks += [left, right]
    return F.array_compact(F.array(*blocks))


def _holding(updates: DataFrame, key: list[str]) -> DataFrame:
    """The value that holds from each boundary day on: (key, day, value or null).

    ``updates`` has ``_from``, ``_to`` (axis days), ``_rank`` and is distinct
    by key and period. Small keys compare boundaries with periods directly;
    keys with more than HOT_ROWS rows fold their periods into dyadic blocks,
    of which each boundary looks up its DAY_BITS + 1 ancestors, so that a key
    holding a third of all rows spreads over all tasks and nothing is
    quadratic. Both ways give the same rows.
    """
    hot = updates.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(*key, F.lit(True).alias("_hot"))
    split = cut_lineage(updates.join(hot, key, "left"))
    few, many = split.where(F.col("_hot").isNull()).drop("_hot"), split.where(F.col("_hot")).drop("_hot")

    def bounds(df: DataFrame) -> DataFrame:
        return df.select(*key, F.explode(F.array("_from", "_to")).alias("day")).distinct()

    r = few.select(*[F.col(k).alias(f"_r_{k}") for k in key], "_from", "_to", "_rank")
    same = [F.col(k) == F.col(f"_r_{k}") for k in key]
    direct = (
        bounds(few)
        .join(r, [*same, F.col("_from") <= F.col("day"), F.col("day") < F.col("_to")], "left")
        .groupBy(*key, "day")
        .agg(F.max("_rank").alias("_rank"))
    )
    shifted = lambda c: F.col(c) + 1  # FIRST_DAY becomes 0
    blocks = (
        many.select(*key, "_rank", F.inline(_dyadic_cover(shifted("_from"), shifted("_to"))))
        .groupBy(*key, "level", "index")
        .agg(F.max("_rank").alias("_rank"))
    )
    looked = bounds(many).select(*key, "day", F.explode(F.sequence(F.lit(0), F.lit(DAY_BITS))).alias("level"))
    looked = looked.withColumn("index", F.expr("cast(shiftright(day + 1, level) as bigint)"))
    indexed = looked.join(blocks, [*key, "level", "index"], "left").groupBy(*key, "day").agg(F.max("_rank").alias("_rank"))
    return direct.unionByName(indexed)


def interval_changes(updates: DataFrame, key: list[str], value: str, start: str, end: str, recorded: str) -> DataFrame:
    """Boundary days of a log of updates with the value that holds from there on.

    A row covers the days from ``start`` (null, blank or unreadable: unbounded)
    up to but excluding ``end`` (likewise) and nothing if the end is not later.
    On each day the covering row recorded last holds; ties fall to the larger
    value, rows without ``recorded`` come first. Rows with a null key or value
    are left out. Repeated rows are folded before the first shuffle.
    """
    day_from, day_to = _axis(lenient_day(F.col(start))), _axis(lenient_day(F.col(end)))
    periods = (
        updates.select(
            *key,
            F.coalesce(day_from, F.lit(FIRST_DAY)).alias("_from"),
            F.coalesce(day_to, F.lit(LAST_DAY)).alias("_to"),
            F.struct(F.coalesce(F.unix_micros(F.col(recorded).cast("timestamp")), F.lit(-(2**62))).alias("at"), F.col(value).alias("value")).alias("_rank"),
        )
        .where((F.col("_from") < F.col("_to")) & F.col("_rank.value").isNotNull())
        .dropna(subset=key)
        .groupBy(*key, "_from", "_to")
        .agg(F.max("_rank").alias("_rank"))
    )
    return _holding(periods, key).select(*key, "day", F.col("_rank.value").alias("value"))


def interval_history(updates: DataFrame, key: list[str], value: str, start: str, end: str, recorded: str) -> DataFrame:
    """Versions (key, value, valid_from, valid_to) of a log of updates; '' for an unbounded side."""
    changes = interval_changes(updates, key, value, start, end, recorded)
    changes = changes.withColumn("hash_diff", F.when(F.col("value").isNotNull(), F.md5("value")))
    rows = satellite(changes, key, "day", "hash_diff")
    return satellite_view(rows, key, "day", "hash_diff", "_end").select(*key, "value", _shown(F.col("day")).alias("valid_from"), _shown(F.col("_end")).alias("valid_to"))


def folded(name: Column) -> Column:
    """A name without regard to letter case and amount of white space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+", " "))


@dataclass
class Satellites:
    """Rows of the mapping's and the names' satellite, and the revisions loaded."""

    mapping: DataFrame
    names: DataFrame
    loads: DataFrame

    def plus(self, more: Satellites) -> Satellites:
        return Satellites(self.mapping.unionByName(more.mapping), self.names.unionByName(more.names), self.loads.unionByName(more.loads))


def with_absences(present: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows of snapshots and, where a key is missing from the next snapshot, a row of that revision without a diff.

    ``present`` has ``_place``, the snapshot's number, ``_next``, the next
    snapshot's revision (null after the last), and ``_known``: the row itself
    is stored already.
    """
    following = F.lead("_place").over(W.partitionBy(*key).orderBy("_place"))
    gone = F.col("_next").isNotNull() & (F.coalesce(following, F.lit(-1)) != F.col("_place") + 1)
    row = lambda at, diff: F.struct(at.alias(order), diff.alias("hash_diff"))
    nothing = F.lit(None).cast("string")
    both = present.withColumn("_gone", gone).withColumn("_rows", F.array_compact(F.array(F.when(~F.col("_known"), row(F.col(order), F.col("hash_diff"))), F.when(F.col("_gone"), row(F.col("_next"), nothing)))))
    return both.select(*key, F.inline("_rows"))


def appended(stored: DataFrame | None, changes: DataFrame, key: list[str], order: str, diff: str) -> DataFrame:
    """The rows that a batch of later changes adds to a stored satellite."""
    if stored is None:
        return satellite(changes, key, order, diff)
    rest = [c for c in changes.columns if c not in key]
    last = stored.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_l")).select(*key, *[F.col(f"_l.{c}").alias(c) for c in rest], F.lit(True).alias("_stored"))
    return satellite(changes.withColumn("_stored", F.lit(False)).unionByName(last), key, order, diff).where(~F.col("_stored")).drop("_stored")


def load_snapshots(snapshots: DataFrame, owner: str, key: str, values: list[str], descriptive: list[str], revision: str, stored: Satellites | None = None) -> Satellites:
    """The satellite rows that snapshots add to the stored ones, which are of earlier revisions.

    All rows of one owner with one revision are one full snapshot, so a key
    that is absent from it is closed. Rows with a null owner, key, value or
    revision map nothing but belong to their snapshot. Repeated rows are folded
    before the shuffle; what remains of a key is at most one row per revision.
    A key that a snapshot gives several values has a chain for each, and one
    with several names all of them in one row.
    """
    link = [owner, key, *values]
    called = F.struct(*[folded(F.col(d)).alias(d) for d in descriptive])
    present = snapshots.select(*link, revision, called.alias("_called")).dropna(subset=[*link, revision]).groupBy(*link, revision).agg(F.array_sort(F.collect_set("_called")).alias("names"))
    new_loads = snapshots.select(owner, revision).dropna().distinct()
    loads, diff = new_loads, F.md5(F.concat_ws("\x1f", *values))
    if stored:
        # the keys held at the end of what is stored take part as a snapshot of their own
        last = stored.loads.groupBy(owner).agg(F.max(revision).alias(revision))
        loads = new_loads.unionByName(last)
        held = satellite_view(stored.mapping, link, revision, "hash_diff", "_end").where(F.col("_end").isNull()).select(*link)
        present = present.unionByName(held.join(last, owner).withColumn("names", F.lit(None).cast(present.schema["names"].dataType)))
    by_load = W.partitionBy(owner).orderBy(revision)
    numbered = loads.withColumns({"_place": F.row_number().over(by_load), "_next": F.lead(revision).over(by_load)})
    placed = present.join(numbered, [owner, revision])
    seen = with_absences(placed.select(*link, revision, "_place", "_next", F.col("names").isNull().alias("_known"), diff.alias("hash_diff")), link, revision)
    named = placed.where(F.col("names").isNotNull()).select(*link, revision, F.md5(F.to_json("names")).alias("hash_diff"), "names")
    return Satellites(
        appended(stored and stored.mapping, seen, link, revision, "hash_diff"),
        appended(stored and stored.names, named, link, revision, "hash_diff"),
        new_loads,
    )


def snapshot_versions(held: Satellites, owner: str, key: str, values: list[str], revision: str) -> DataFrame:
    """(owner, key, values, name, begin, end) of every version, by revision; end null while it lasts.

    Point in time: at each revision of either satellite the state of both. One
    window pass over their rows, without a join; a version with several names
    counts once for each, as long as it bears the name.
    """
    link = [owner, key, *values]
    kind = held.names.schema["names"].dataType
    rows = held.mapping.select(*link, revision, F.struct(F.col("hash_diff").isNotNull().alias("here")).alias("_m"), F.lit(None).cast(kind).alias("_n"))
    rows = rows.unionByName(held.names.select(*link, revision, F.lit(None).cast("struct<here:boolean>").alias("_m"), F.col("names").alias("_n")))
    so_far = W.partitionBy(*link).orderBy(revision).rangeBetween(W.unboundedPreceding, 0)
    state = rows.select(*link, revision, F.last("_m", True).over(so_far)["here"].alias("_here"), F.last("_n", True).over(so_far).alias("names"))
    state = state.withColumn("hash_diff", F.when(F.col("_here"), F.md5(F.to_json("names"))))
    view = satellite_view(satellite(state, link, revision, "hash_diff"), link, revision, "hash_diff", "_end")
    each = view.select(*link, F.explode("names").alias("name"), F.col(revision).alias("begin"), F.col("_end").alias("end"))
    # a name that stays while another one of the key comes or goes is one version
    chain = W.partitionBy(*link, "name").orderBy("begin")
    run = each.withColumn("_new", (~F.lag("end").over(chain).eqNullSafe(F.col("begin"))).cast("int")).withColumn("_run", F.sum("_new").over(chain))
    return run.groupBy(*link, "name", "_run").agg(F.min("begin").alias("begin"), F.max_by("end", "begin").alias("end")).drop("_run")


def snapshot_history(snapshots: DataFrame, owner: str, key: str, values: list[str], descriptive: list[str], revision: str) -> DataFrame:
    """Versions (owner, key, values, valid_from, valid_to) by UTC day of the revisions (epoch seconds)."""
    return _days(snapshot_versions(load_snapshots(snapshots, owner, key, values, descriptive, revision), owner, key, values, revision), [owner, key, *values])


def _days(versions: DataFrame, cols: list[str]) -> DataFrame:
    day = lambda c: F.coalesce(F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd"), F.lit(""))
    return versions.select(*cols, day("begin").alias("valid_from"), day("end").alias("valid_to"))


REGION = ("provider", "provider_region_id", ["region_id"], ["provider_name"], "data_revision")


def region_history_in_batches(region_provider_map: DataFrame, batches: int = 2) -> DataFrame:
    """The history of the regions loaded batch by batch, each of so many successive revisions; equals that of one load."""
    owner, key, values, descriptive, revision = REGION
    first, last = region_provider_map.agg(F.min(revision), F.max(revision)).first()
    part = F.floor((F.col(revision) - (first or 0)) * batches / ((last or 0) + 1 - (first or 0)))
    held = None
    for i in range(batches):
        more = load_snapshots(region_provider_map.where(part == i), *REGION, stored=held)
        more = Satellites(cut_lineage(more.mapping), cut_lineage(more.names), cut_lineage(more.loads))
        held = held.plus(more) if held else more
    return _days(snapshot_versions(held, owner, key, values, revision), [owner, key, *values]).distinct()


def mapping_history(provider_entity_map: DataFrame, region_provider_map: DataFrame) -> DataFrame:
    """The full history of both provider maps in one table of distinct versions."""
    cols = ["source_table", "provider", "provider_key", "mapped_id", "valid_from", "valid_to"]
    entity = interval_history(provider_entity_map, ["provider", "provider_entity_id"], "entity_id", "active_from", "active_to", "recorded_at")
    entity = entity.select(F.lit("provider_entity_map").alias("source_table"), "provider", F.col("provider_entity_id").alias("provider_key"), F.col("value").alias("mapped_id"), "valid_from", "valid_to")
    region = snapshot_history(region_provider_map, *REGION)
    region = region.select(F.lit("region_provider_map").alias("source_table"), "provider", F.col("provider_region_id").alias("provider_key"), F.col("region_id").alias("mapped_id"), "valid_from", "valid_to")
    return entity.select(cols).unionByName(region.select(cols)).distinct()
