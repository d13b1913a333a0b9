"""Neighbours of sketches within a radius, as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.config import CorrConfig
from sparkcorr.functions.window_math import total
from sparkcorr.operators import sketch as sk
from sparkcorr.operators.blocks import block_neighbours, block_votes
from sparkcorr.operators.pairs import band_join
from sparkcorr.shipping import ship


def with_negatives(sketched: DataFrame) -> DataFrame:
    """Each sketch and its negative: a neighbour of the latter is negatively correlated."""
    sign = F.explode(F.array(F.lit(1), F.lit(-1)))
    out = sketched.withColumn("__sign", sign)
    return out.withColumn("sketch", F.transform("sketch", lambda x: x * F.col("__sign"))).drop("__sign")


def _cells(left: DataFrame, right: DataFrame, tau: float) -> tuple[DataFrame, DataFrame]:
    """Cells of width tau on the first coordinate, and on the second if there is one; neighbours are
    in the same cell or the next: the right side goes to all those."""
    for k in (1, 2):
        cell = F.floor(F.coalesce(F.get("sketch", F.lit(k - 1)), F.lit(0).cast("double")) / F.lit(tau)).cast("long")
        left = left.withColumn(f"cell{k}", cell)
        right = right.withColumn(f"cell{k}", F.explode(F.array(cell - 1, cell, cell + 1)))
    return left, right


def squared_distance(u, v):
    return total(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)))


def neighbours(sketched: DataFrame, cfg: CorrConfig, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of sketches (id, t0, sketch, ...) at ``tau`` or less within the lag; distinct."""
    probe = with_negatives(sketched) if cfg.neg_corr else sketched
    left, right = _cells(sketched, probe, cfg.tau)
    close = squared_distance(F.col("x_sketch"), F.col("y_sketch")) <= F.lit(cfg.tau**2)
    out = band_join(left, right, cfg, extra=close, extra_keys=("cell1", "cell2", *keys))
    columns = ["x_id", "x_t0", "y_id", "y_t0", *(f"x_{k}" for k in keys)]
    return out.select(*columns).distinct() if cfg.neg_corr else out.select(*columns)


def candidates(windows: DataFrame, cfg: CorrConfig) -> DataFrame:
    """(x_id, x_t0, y_id, y_t0, votes): pairs that the sketches propose. Constant windows have none.

    Whole sketches propose with one vote; partitioned ones with a vote a grid, of which
    ``freq_threshold`` must agree.
    """
    return proposed(sk.sketches(windows.where(~F.col("is_const")), cfg).select("id", "t0", "sketch"), cfg)


def proposed(sketched: DataFrame, cfg: CorrConfig) -> DataFrame:
    """The candidates of sketches (id, t0, sketch)."""
    if not cfg.partitioned:
        return neighbours(sketched, cfg).withColumn("votes", F.lit(1).cast("long"))
    found = neighbours(sk.chunks(sketched, cfg), cfg, keys=("grid",))
    votes = found.groupBy("x_id", "x_t0", "y_id", "y_t0").agg(F.count("*").alias("votes"))
    return votes.where(F.col("votes") >= F.lit(float(cfg.min_votes)))


def with_payload(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Attach arrays and moments to the proposed pairs only."""
    payload = windows.select("id", "t0", "xs", "s1", "s2", "is_spiked")
    for s in "xy":
        side = payload.select(*(F.col(c).alias(f"{s}_{c}") for c in payload.columns))
        pairs = pairs.join(side, [f"{s}_id", f"{s}_t0"])
    return pairs


def vector_neighbours(vectors: DataFrame, tau: float, *, id_col: str, vector_col: str, negatives: bool = False, blocks: int = 8) -> DataFrame:
    """(id1, id2, sign, dist) of vectors of any table at ``tau`` or less, id1 < id2; ids are whole numbers.

    For unit vectors, ``tau = sqrt(2 (1 - r))`` means a cosine of r or more; with ``negatives``,
    -r or less too. Vectors meet in cells of the first two coordinates; as a wide radius leaves few
    cells, each cell's vectors are dealt to ``blocks`` times ``blocks`` keys as well, and a pair meets
    under one of them. Under a key, distances come from matrix products.
    """
    ship(vectors.sparkSession)
    base = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("sketch"))
    probe = base.withColumn("sign", F.lit(1))
    if negatives:
        probe = probe.unionByName(base.select("id", F.transform("sketch", lambda x: -x).alias("sketch"), F.lit(-1).alias("sign")))
    left, right = _cells(base, probe, tau)
    own, every = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left, right = left.withColumn("block1", own).withColumn("block2", every), right.withColumn("block2", own).withColumn("block1", every)
    keys = ["cell1", "cell2", "block1", "block2"]
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: block_neighbours(a, b, tau), "id1 long, id2 long, sign int, dist double")


def coordinate_votes(vectors: DataFrame, tau: float, min_votes: int, *, id_col: str, vector_col: str, dims: int, block: int = 8192) -> DataFrame:
    """(id1, id2, votes): in how many of the first ``dims`` coordinates two vectors differ by ``tau`` or less.

    Vectors are dealt to blocks of about ``block`` by their ids, and to a key for each other block; under a key votes are
    counted in tiles, so that only the pairs with votes enough leave it. Rows that share an id add up their votes.
    """
    ship(vectors.sparkSession)
    coordinates = F.slice(F.transform(vector_col, lambda x: x.cast("double")), 1, dims)
    one = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), coordinates.alias("u"))
    blocks = max(1, -(-one.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    dealt = one.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.select("id", "u", "own", F.least("own", "other").alias("block1"), F.greatest("own", "other").alias("block2"))
    id_type = dict(one.dtypes)["id"]
    return dealt.groupBy("block1", "block2").applyInArrow(lambda t: block_votes(t, tau, min_votes, dims), f"id1 {id_type}, id2 {id_type}, votes long")
