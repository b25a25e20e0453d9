"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact cosine.

A rotation of the principal directions is learned on a bounded sample so that
the signs of the rotated vectors make balanced 64-bit codes. The code is cut
into five substrings, each a hash table; vectors meet if a substring differs in
at most one bit, and each pair is met in the first such table only. Original
vectors then decide.

Vectors with one code that lie within half the sought angle of the code's
smallest id form a class: by the triangle inequality all of them are linked.
Classes meet instead of vectors, and two classes that are near or far enough
are decided by their pivots alone. Equal vectors of a label are one vector with
the number of its rows, so copies cost no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.functions.vectors import dot, norm
from corpusloom.llm.components import connected_components
from corpusloom.session import materialize

BITS = 64
TABLES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bits (of 64) in which codes may differ; at a cosine of 0.98 the mean is 4.1 and the deviation 2.
MAX_DIFFERING = 14
SAMPLE = 4096
ROUNDS = 30
#: Room for rounding in angles that are compared without looking at the pair itself.
SLACK = 1e-6


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Projection whose signs are the code; short vectors get several rotations side by side.

    The rows are unit vectors and are not centred: two vectors then differ in a
    bit with a chance set by their angle alone, however narrow their cone is.
    """
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    _, directions = np.linalg.eigh(sample.T @ sample)
    blocks, left = [], bits
    while left > 0:
        take = min(width, left)
        basis = directions[:, ::-1][:, :take]
        seen = sample @ basis
        rotation = np.linalg.qr(rng.normal(size=(take, take)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(seen @ rotation).T @ seen)
            rotation = (u @ v).T
        blocks.append(basis @ rotation)
        left -= take
    return np.hstack(blocks)


def codes_of(units: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = units @ projection > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with a row number, and the distinct vectors that can link, each under its first row's number.

    Rows: rid, vec_id, label, unit (null: links with nothing). Vectors: rid,
    vec_id (the smallest), label, dim, unit, n (rows that hold it).
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    infinite = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scale = F.array_max(F.transform("v", F.abs))
    linking = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~infinite & (scale > 0)
    scaled = let(scale, lambda most: F.transform("v", lambda x: x / most))
    unit = let(scaled, lambda s: let(norm(s), lambda n: F.transform(s, lambda x: x / n)))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), F.col(label_col).alias("label"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.when(linking, unit).alias("unit"))
    rows = materialize(rows, "vectors")
    distinct = rows.filter(F.col("unit").isNotNull()).groupBy("label", "unit").agg(F.min("rid").alias("rid"), F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    return rows, materialize(distinct.select("rid", "vec_id", "label", F.size("unit").alias("dim"), "unit", "n"), "distinct-vectors")


def _coded(good: DataFrame, sample: int) -> DataFrame:
    counts = {r["dim"]: r["count"] for r in good.groupBy("dim").count().collect()}
    models = {}
    for dim, n in counts.items():
        mine = good.filter(F.col("dim") == dim)
        share = F.pmod(F.xxhash64("unit", "rid"), F.lit(1 << 30)) < min(1.0, 1.2 * sample / n) * (1 << 30)
        rows = mine.filter(share).select("unit").limit(2 * sample).collect()  # the fit's documented sample
        models[dim] = learn_rotation(np.array([r["unit"] for r in rows] or [[0.0] * dim]))
    shared = good.sparkSession.sparkContext.broadcast(models)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(3))
            out = np.zeros(len(dims), dtype=np.int64)
            units = batch.column(4)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                block = units.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                out[at] = codes_of(block, shared.value[int(dim)])
            yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "code"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in good.schema)
    return good.mapInArrow(code, f"{fields}, code long")


def _part(code: Column, table: int) -> Column:
    shift, width = TABLES[table]
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def class_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of one label whose codes meet in a table and are near, each once."""
    def side(name: str, probe: bool) -> DataFrame:
        looks = [(t, at, (1 << width) - 1, flip) for t, (at, width) in enumerate(TABLES) for flip in [0, *((1 << i for i in range(width)) if probe else ())]]
        each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("t", "at", "mask", "flip"), look, strict=True)]) for look in looks]))
        one = classes.select("label", "dim", F.col("class").alias(name), F.col("code").alias(f"code_{name}"), each.alias("m"))
        part = F.expr(f"(shiftrightunsigned(code_{name}, m.at) & bigint(m.mask)) ^ bigint(m.flip)")
        return one.select("label", "dim", F.col("m.t").alias("t"), part.alias("p"), name, f"code_{name}")

    x, y = side("a", True), side("b", False).withColumnsRenamed({"label": "_l", "dim": "_d", "t": "_t", "p": "_p"})
    apart = F.col("code_a").bitwiseXOR(F.col("code_b"))
    first = F.lit(True)
    for t in range(len(TABLES) - 1):
        first = first & ((F.col("t") <= t) | (F.bit_count(_part(apart, t)) > 1))
    on = (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("t") == F.col("_t")) & (F.col("p") == F.col("_p"))
    near = F.bit_count(apart) <= MAX_DIFFERING
    return x.join(y, on & (F.col("a") < F.col("b")) & near & first).select("a", "b")


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE
) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row.

    Vectors are compared if their labels are equal and not null and their
    lengths agree. A null vector, an empty or zero one, and one with a null or
    non-finite component is linked with nothing. Repeated rows are vectors of
    their own and linked with each other. Every link that is counted has a
    cosine of at least ``threshold``; a pair is missed only if no table brings
    it together (about 3 in 10,000 at the threshold). A null id has a null
    component unless it is linked to others, and is kept if nothing smaller is
    linked to it.
    """
    rows, distinct = _usable(vectors, id_col, vector_col, label_col)
    coded = materialize(_coded(distinct, sample), "codes")
    angle = math.acos(threshold)
    pivots = coded.groupBy("label", "dim", "code").agg(F.min(F.struct("rid", "unit")).alias("p"))
    near = coded.join(pivots, ["label", "dim", "code"])
    to_pivot = F.when(F.col("rid") == F.col("p.rid"), F.lit(1.0)).otherwise(dot(F.col("unit"), F.col("p.unit")))
    inside = F.col("c") >= math.cos(angle / 2 - SLACK)
    members = near.withColumn("c", to_pivot).select(
        "rid", "vec_id", "label", "dim", "code", "unit", "n",
        F.when(inside, F.col("p.rid")).otherwise(F.col("rid")).alias("class"),
        F.when(inside, F.acos(F.least("c", F.lit(1.0)))).otherwise(0.0).alias("turn"),
    )
    members = materialize(members, "members")
    # k distinct vectors, w rows
    sizes = members.groupBy("class").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.max("turn").alias("reach"))
    classes = materialize(members.filter(F.col("rid") == F.col("class")).join(sizes, "class"), "classes")
    ends = lambda n: classes.select(F.col("class").alias(n), F.col("unit").alias(f"u{n}"), *[F.col(c).alias(f"{c[0]}{n}") for c in ("k", "w", "reach")])
    met = class_pairs(classes).join(ends("a"), "a").join(ends("b"), "b").withColumn("c", dot(F.col("ua"), F.col("ub")))
    turn, reach = F.acos(F.greatest(F.least("c", F.lit(1.0)), F.lit(-1.0))), F.col("ra") + F.col("rb")
    verdict = (
        F.when(F.col("ka") + F.col("kb") == 2, F.when(F.col("c") >= threshold, "all"))
        .when(turn + reach <= angle - SLACK, "all")
        .when(turn - reach <= angle + SLACK, "some")
    )
    judged = materialize(met.withColumn("v", verdict).filter("v IS NOT NULL").select("a", "b", "wa", "wb", "v"), "judged")
    whole = judged.filter("v = 'all'")
    of_class = (
        whole.select(F.col("a").alias("class"), F.col("wb").alias("n")).unionAll(whole.select(F.col("b").alias("class"), F.col("wa").alias("n")))
        .groupBy("class").agg(F.sum("n").alias("n"))
    )
    one = lambda n: members.select(F.col("class").alias(n), F.col("rid").alias(f"x{n}"), F.col("unit").alias(f"u{n}"), F.col("n").alias(f"n{n}"))
    some = judged.filter("v = 'some'").select("a", "b").join(one("a"), "a").join(one("b"), "b")
    linked = materialize(some.filter(dot(F.col("ua"), F.col("ub")) >= threshold).select("a", "b", "xa", "xb", "na", "nb"), "member-links")
    of_member = (
        linked.select(F.col("xa").alias("rid"), F.col("nb").alias("m")).unionAll(linked.select(F.col("xb").alias("rid"), F.col("na").alias("m")))
        .groupBy("rid").agg(F.sum("m").alias("m"))
    )
    labels = connected_components(whole.select("a", "b").unionAll(linked.select("a", "b")).distinct())
    tagged = members.join(labels, members["class"] == labels["node"], "left").select("rid", "class", "vec_id", F.coalesce("component", "class").alias("part"))
    least = tagged.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    counted = (
        tagged.join(sizes.select("class", "w"), "class").join(of_class, "class", "left").join(of_member, "rid", "left").join(least, "part")
        .select("rid", (F.col("w") - 1 + F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    )
    linking = rows.filter(F.col("unit").isNotNull()).select("vec_id", "label", "unit").join(distinct.select("label", "unit", "rid"), ["label", "unit"])
    lone = rows.filter(F.col("unit").isNull()).select("vec_id", F.lit(None).cast("bigint").alias("n_links"), F.lit(None).cast(rows.schema["vec_id"].dataType).alias("component_id"))
    out = linking.select("rid", "vec_id").join(counted, "rid").select("vec_id", "n_links", "component_id").unionAll(lone)
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )
