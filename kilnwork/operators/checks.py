"""Audit metrics and validation checks. Each check gives its violations; none means passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.operators import order as O


def histogram(df: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def page_summary(blocks: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    """pages, blocks, least, most and mean blocks of a page, and whether pages follow one another without a gap."""
    per = blocks.groupBy(*keys, page).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("blocks"), F.min("n").alias("least"), F.max("n").alias("most"), F.bround(F.avg("n"), 4).alias("mean"), (F.max(page) - F.min(page) + 1 == F.count(F.lit(1))).alias("continuous"))


def sampled(df: DataFrame, keys: Sequence[str], bad: Column, sample: str, k: int = 20) -> DataFrame:
    """How many rows are bad, and the first ``k`` of them in order (a report's sample)."""
    b = df.where(bad)
    counts = b.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    # The filter on the rank limits each task's rows of a key before they are shuffled.
    first = b.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(sample))).where(F.col("__n") <= k)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(sample)).alias("sample"))
    return first.join(counts, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]).select(*keys, "n", "sample")


def duplicate_blocks(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows whose keys an earlier row has, with the first such row."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("first_at", F.first(order).over(w)).where(F.col(order) != F.col("first_at"))


def bad_boxes(df: DataFrame, bounds: Sequence[float] = (0, 0, 1000, 1040), tolerance: float = 10) -> DataFrame:
    """Adds ``problem``: malformed or out_of_bounds."""
    at = lambda i: F.get("bbox", F.lit(i - 1))
    malformed = F.col("bbox").isNull() | (F.size("bbox") != 4) | (at(3) < at(1)) | (at(4) < at(2))
    out = (at(1) < bounds[0] - tolerance) | (at(2) < bounds[1] - tolerance) | (at(3) > bounds[2] + tolerance) | (at(4) > bounds[3] + tolerance)
    return df.withColumn("problem", F.when(malformed, "malformed").when(out, "out_of_bounds")).where("problem is not null")


def text_audit(df: DataFrame, keys: Sequence[str], kind: str, text: str, short: int = 4) -> DataFrame:
    """Empty and short texts by kind."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(size == 0).alias("n_empty"), F.count_if((size > 0) & (size < short)).alias("n_short"))


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: str, roots: Sequence[str] = ()) -> DataFrame:
    known = df.select(F.col(key).alias("__k")).distinct()
    return df.where(F.col(parent).isNotNull() & ~F.coalesce(F.col(parent).isin(*roots) if roots else F.lit(False), F.lit(False))).join(known, F.col(parent) == F.col("__k"), "left_anti")


def cycles(df: DataFrame, key: str, parent: str, depth: int = 6) -> DataFrame:
    """Rows from which ``depth`` steps upwards don't reach a top row."""
    up = df.select(F.col(key).alias("__k"), F.col(parent).alias("__p"))
    walk = df.select(F.col(key), F.col(parent).alias("at"))
    for _ in range(depth):
        walk = walk.join(up, F.col("at") == F.col("__k"), "left").select(key, F.col("__p").alias("at"))
    return walk.where("at is not null").select(key)


def wrong_ends(secs: DataFrame, keys: Sequence[str], position: str, level: str, claimed: str) -> DataFrame:
    """Sections whose claimed end is not the next heading of the same or a higher rank."""
    return O.ends(secs.withColumn("__claimed", F.col(claimed)), keys, position, level).where(~F.col("__claimed").eqNullSafe(F.col("next_at")))


def wrong_bindings(blocks: DataFrame, secs: DataFrame, keys: Sequence[str], position: str, bound: str) -> DataFrame:
    """Blocks not bound to the last heading at or before them, which is the deepest section around them."""
    s = secs.select(*keys, position, F.col("section_id").alias("__s"))
    b = blocks.join(s, [*keys, position], "left")
    return O.bind_last(b, keys, position, F.col("__s"), "__last").where(F.col("__last").isNotNull() & (F.col("__last") != F.col(bound)))


def not_consecutive(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Keys whose numbers aren't 1 to n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi")).where("n <> d or lo <> 1 or hi <> n")


def first_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], position: str, token: str) -> DataFrame:
    """The first place at which two sequences differ, for each key; their places are 1, 2, ... in order of position."""
    seq = lambda d, name: d.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(position)).alias("place"), F.col(token).alias(name))
    both = seq(a, "left_token").join(seq(b, "right_token"), [*keys, "place"], "full")
    return both.where(~F.col("left_token").eqNullSafe(F.col("right_token"))).groupBy(*keys).agg(F.min_by(F.struct("place", "left_token", "right_token"), "place").alias("d")).select(*keys, "d.*")


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, counting repeats, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def boundary_inside(members: DataFrame, boundaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fused runs (keys, first_at, last_at) with a boundary (keys, at) strictly inside."""
    return members.join(boundaries, list(keys)).where((F.col("at") > F.col("first_at")) & (F.col("at") < F.col("last_at")))


def asset_counts(records: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(origin, expected, found) where the numbers differ."""
    found = records.groupBy("origin").agg(F.count(F.lit(1)).alias("found"))
    want = records.sparkSession.createDataFrame(list(expected.items()), "origin string, expected long")
    return want.join(found, "origin", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("found <> expected")


def changed_assets(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose file is gone or has other content. ``files``: path, content."""
    f = files.select(F.col("path").alias("original_path"), F.sha2("content", 256).alias("now"))
    return records.where("exists").join(f, "original_path", "left").where("now is null or now <> sha256")


def forbidden_fields(df: DataFrame, pattern: str) -> list[str]:
    """Names in the schema, at any depth, that match."""
    import re

    from pyspark.sql.types import ArrayType, MapType, StructType

    out: list[str] = []

    def walk(kind, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                if re.search(pattern, f.name):
                    out.append(f"{path}{f.name}")
                walk(f.dataType, f"{path}{f.name}.")
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, MapType):
            walk(kind.valueType, path)

    walk(df.schema, "")
    return out


def fingerprint(df: DataFrame) -> Column | int:
    """A number for the table's rows, the same whatever their order: equal for two runs of a deterministic flow."""
    return df.agg(F.coalesce(F.sum((F.xxhash64(*df.columns) % 1_000_000_007).cast("decimal(38,0)")), F.lit(0))).first()[0]


def acceptance(violations: dict[str, DataFrame]) -> dict[str, int]:
    """Number of violations of each check."""
    return {name: v.count() for name, v in violations.items()}
