"""Train, validation and test splits that keep related records together.

Method: records that share an entity are edges of a graph of entities; its
connected components come from alternating large-star and small-star steps
(Kiveris et al. 2014), each a partial aggregation and a join; a component's hash
then falls into a proportional split range. Ranges are cut on the cumulative
rows of hash buckets within each label, so proportions hold per label although
components differ in size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.operators.skew import hot_split_join
from tallyloom.session import materialise

#: Subject ids that say only that the subject is unknown or that none applies,
#: without case and non-alphanumeric characters. Fixed values.
PLACEHOLDER_SUBJECTS = (
    "anon", "anonymous", "empty", "missing", "na", "nan", "nil", "noid", "nodata", "none", "notapplicable", "notavailable",
    "notknown", "nosubject", "null", "subjectunknown", "tba", "tbd", "undefined", "unidentified", "unk", "unknown", "unknownsubject", "unspecified",
)


def subject_key(subject: Column) -> Column:
    """What makes two subject ids equal: letters and digits without case; null for a placeholder."""
    key = F.regexp_replace(F.lower(subject), r"[^\p{L}\p{N}]", "")
    return F.when((key != "") & ~key.isin(*PLACEHOLDER_SUBJECTS), key)


def digest_key(digest: Column) -> Column:
    """A SHA-256 in lower case; null unless it is 64 hexadecimal digits, not all the same."""
    low = F.lower(digest)
    return F.when(low.rlike("^[0-9a-f]{64}$") & ~low.rlike(r"^(.)\1{63}$"), low)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node in an edge; nodes are strings.

    Self-loops and repeated edges change nothing; edges with a null end are left
    out. Each round writes its edges to the shared folder, so lineage stays short.
    Stops when a round changes no edge; raises after ``rounds``.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    held = materialise(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("u"), low.alias("v")).distinct(), "component-edges")
    mark = _fingerprint(held)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        # Large star: each node links its larger neighbours to its least neighbour.
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upward = held.select(F.col("v").alias("u"), F.col("u").alias("v"))
        starred = hot_split_join(upward, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = materialise(starred, "large-star")
        # Small star: each node links its smaller neighbours and itself to the least of them.
        down = starred.groupBy("u").agg(F.min("v").alias("m"))
        moved = hot_split_join(starred, down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = materialise(moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _fingerprint(held)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple[int, int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u", "v")).alias("y")).first()
    return (r.n, r.x or 0, r.y or 0)


def with_component(records: DataFrame, record_id: str, keys: Sequence[Column]) -> DataFrame:
    """The records with ``component``, a string equal for records related through any key, also through others.

    keys: entity keys, null where a record has none. A record without any key is
    related only to records of the same id. Column names used inside start with
    an underscore; the records' own columns stay as they are.
    """
    tagged = [F.concat(F.lit(f"{i}:"), k) for i, k in enumerate(keys)]
    held = materialise(records.withColumn("_keys", F.filter(F.array(*tagged), lambda x: x.isNotNull())).withColumn("_node", F.try_element_at("_keys", F.lit(1))), "split-records")
    labels = _node_labels(held, len(tagged))
    alone = F.concat(F.lit("record:"), F.coalesce(F.col(record_id).cast("string"), F.lit("")))
    joined = hot_split_join(held, labels, "_node", "left")
    return joined.select(*records.columns, F.coalesce("_component", "_node", alone).alias("component"))


def _node_labels(held: DataFrame, most: int) -> DataFrame:
    """_node and _component of the first keys of records that are related through other keys.

    First a star step on the other keys: such a key moves to the least first key
    beside it, and all first keys beside it are linked to that one. A key beside a
    single first key, as nearly all are, gives no edge, so the rounds that follow
    see only keys that relate something.
    """
    pairs = materialise(held.where(F.size("_keys") > 1).select(F.col("_node").alias("a"), F.explode(F.slice("_keys", 2, most)).alias("b")), "split-pairs")
    beside = materialise(pairs.groupBy("b").agg(F.min("a").alias("m"), F.max("a").alias("_x")), "split-beside")
    linked = hot_split_join(pairs, beside.where("m <> _x").select("b", "m"), "b").where("a <> m").select("a", F.col("m").alias("b"))
    # Keys that are some record's first key for want of an earlier one.
    late = held.where(~F.col("_node").startswith("0:")).select(F.col("_node").alias("b")).distinct()
    moved = materialise(beside.select("b", "m").join(late, "b"), "split-moved")
    found = connected_components(linked.unionByName(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))))
    return found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))


def leaking_components(records: DataFrame, split: str = "split") -> DataFrame:
    """component of every group with two or more different non-null splits."""
    return records.where(F.col(split).isNotNull()).groupBy("component").agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b").select("component")


def assign_splits(records: DataFrame, label: str = "label", proportions: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), buckets: int = 4096, seed: int = 7) -> DataFrame:
    """component, stratum (its most frequent label; null counts as a label) and new_split of every component.

    A component's hash picks one of ``buckets`` buckets of its stratum; a bucket's
    split follows from where the middle of its rows lies in the stratum's running
    total, so the shares hold to within a bucket. A component larger than a share
    stays whole and the others make room. The table of buckets has at most
    ``buckets`` rows a label.
    """
    total = sum(p for _, p in proportions)
    sized = records.groupBy("component", F.col(label).alias("_l")).count().groupBy("component").agg(F.max_by("_l", F.struct("count", F.coalesce("_l", F.lit("")))).alias("stratum"), F.sum("count").alias("_n"))
    placed = materialise(sized.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(buckets))), "split-components")
    per = placed.groupBy("stratum", "_bucket").agg(F.sum("_n").alias("_n"))
    run = W.partitionBy("stratum").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    at = (F.sum("_n").over(run) - F.col("_n") / 2) / F.sum("_n").over(W.partitionBy("stratum"))
    choice, edge = F.lit(proportions[-1][0]), 1.0
    for (name, _), (_, later) in reversed(list(zip(proportions[:-1], proportions[1:], strict=True))):
        edge -= later / total
        choice = F.when(at < edge, name).otherwise(choice)
    ranges = per.select(F.col("stratum").alias("_s"), "_bucket", choice.alias("new_split")).withColumnRenamed("_bucket", "_b")
    return placed.join(ranges, F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).select("component", "stratum", "new_split")
