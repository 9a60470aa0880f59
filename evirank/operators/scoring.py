"""A learned pair score: a small feed-forward network over the sum of two fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scratch import materialize
from .ranking import keep_first, order, top_n


@dataclass
class Network:
    """Layers (weights, bias), ReLU between them; the score is the sigmoid of the single output."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def random(cls, dim: int, hidden: tuple[int, ...] = (16, 8), seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        sizes = [dim, *hidden, 1]
        return cls([(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w, b = self.layers[0]
        return Network(self.layers[1:]).after(x @ w + b)

    def after(self, x: np.ndarray) -> np.ndarray:
        """The score from what the layer before these gave."""
        for w, b in self.layers:
            x = np.maximum(x, 0) @ w + b
        return 1 / (1 + np.exp(-np.clip(x[:, 0], -500, 500)))


def unpack(words: list[list[int]] | np.ndarray, dim: int) -> np.ndarray:
    packed = np.array(words, np.int64).reshape(len(words), -1)
    return np.unpackbits(packed.view(np.uint8), axis=1, bitorder="little")[:, :dim].astype(np.float64)


def best_models(registry: DataFrame, domains: DataFrame) -> DataFrame:
    """uniprot_id, pfam_id: of a protein's domains with a trained model the one of the highest val_pr_auc
    (nulls last), then the smallest pfam_id."""
    trained = registry.where("status = 'trained'") if "status" in registry.columns else registry
    auc = registry.columns.count("val_pr_auc") > 0
    by = order("-val_pr_auc", "pfam_id") if auc else order("pfam_id")
    return keep_first(domains.join(trained, "pfam_id"), ["uniprot_id"], by).select("uniprot_id", "pfam_id")


#: One layer of a domain's network a row: n_in inputs, weights row by row, as many outputs as the bias has numbers.
MODEL_TABLE = "pfam_id string, layer int, n_in int, weights array<double>, bias array<double>"


def model_table(spark: SparkSession, networks: dict[str, Network]) -> DataFrame:
    """The networks as a table, to be written once and joined with the seeds of their domains."""
    rows = [(pfam, i, len(w), w.ravel().tolist(), b.tolist()) for pfam, net in networks.items() for i, (w, b) in enumerate(net.layers)]
    return spark.createDataFrame(rows, MODEL_TABLE)


def _network(rows: pa.Table) -> Network:
    layers = {r["layer"]: (np.array(r["weights"], np.float64).reshape(r["n_in"], -1), np.array(r["bias"], np.float64)) for r in rows.to_pylist()}
    return Network([layers[i] for i in sorted(layers)])


def _best(score: np.ndarray, place: np.ndarray, n: int | None) -> np.ndarray:
    """Indices of the n highest scores, of equal ones those of the lowest place."""
    return np.arange(len(score)) if n is None or len(score) <= n else np.lexsort((place, -score))[:n]


def score_blocks(
    seeds: DataFrame, targets: DataFrame, models: DataFrame, dim: int, threshold: float, per_seed: int | None, seed_block: int = 256, target_block: int = 262_144, pieces: int = 16, rows_at_once: int = 8192
) -> DataFrame:
    """pfam_id, query_id, target_id, bsi_score of at least the threshold: each distinct seed of a domain that has a model
    against all targets, its best ``per_seed`` (ties: the smallest target_id).  Scores are rounded to nine places.

    The work is a grid.  A domain's seeds are dealt into pieces of about ``seed_block`` rows, which take the domain's
    model with them; some ``pieces`` make a unit; the targets are dealt into blocks; a task scores one unit against one
    block.  Neither seeds, models nor targets pass through the driver, and no task holds more than a unit and a block,
    however many seeds there are or one domain has.  seeds: pfam_id, query_id, words.  targets: target_id, words.
    models: see ``MODEL_TABLE``; a domain without one gives nothing.  Rows without a key or words are left out.
    """
    kinds = {"pfam_id": seeds.schema["pfam_id"], "query_id": seeds.schema["query_id"], "target_id": targets.schema["target_id"]}
    layers = models.select(F.col("pfam_id").cast(kinds["pfam_id"].dataType).alias("pfam_id"), "layer", "n_in", "weights", "bias")
    have = seeds.where("pfam_id is not null and query_id is not null and words is not null").join(layers.select("pfam_id").distinct(), "pfam_id", "left_semi")
    distinct = materialize(have.select("pfam_id", "query_id", "words").dropDuplicates(["pfam_id", "query_id"]), "seeds")
    sizes = distinct.groupBy("pfam_id").agg(F.ceil(F.count("*") / seed_block).cast("int").alias("__n"))
    n_pieces = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    units, blocks = -(-n_pieces // pieces) or 1, -(-targets.count() // target_block) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit = F.pmod(F.xxhash64("pfam_id", "__piece"), F.lit(units)).cast("int").alias("unit")
    block = F.pmod(F.xxhash64("target_id"), F.lit(blocks)).cast("int").alias("block")
    dealt = distinct.join(sizes, "pfam_id").withColumn("__piece", F.pmod(F.xxhash64("query_id"), F.col("__n")).cast("int"))
    homes = sizes.select("pfam_id", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__piece"))
    left = dealt.select(unit, "pfam_id", "query_id", "words").unionByName(layers.join(homes.select("pfam_id", unit).distinct(), "pfam_id"), allowMissingColumns=True)
    right = targets.where("target_id is not null and words is not null").select("target_id", "words", block).withColumn("unit", every(units))
    out = T.StructType([*kinds.values()]).add("bsi_score", "double")
    arrow = pa.schema([(name, to_arrow_type(f.dataType)) for name, f in kinds.items()] + [("bsi_score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = arrow.empty_table()
        if not left.num_rows or not right.num_rows:
            return nothing
        order = pc.sort_indices(right.column("target_id"))
        right = right.take(order)  # a row's place is its rank by id
        words = np.array(right.column("words").to_pylist(), np.int64)
        found = []
        for pfam in pc.unique(left.column("pfam_id")):
            own = left.filter(pc.equal(left.column("pfam_id"), pfam))
            net, mine = _network(own.filter(pc.is_valid(own.column("layer")))), own.filter(pc.is_null(own.column("layer")))
            if not mine.num_rows:
                continue
            (first, bias), rest = net.layers[0], Network(net.layers[1:])
            q = unpack(mine.column("words").to_pylist(), dim) @ first + bias
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
            for at in range(0, len(words), rows_at_once):
                x = unpack(words[at : at + rows_at_once], dim) @ first  # (x + q) W = x W + q W
                for i in range(len(q)):
                    s = np.round(rest.after(x + q[i]), 9)
                    ok = np.flatnonzero(s >= threshold)
                    if len(ok):
                        s, place = np.concatenate([best[i][0], s[ok]]), np.concatenate([best[i][1], ok + at])
                        keep = _best(s, place, per_seed)
                        best[i] = s[keep], place[keep]
            counts = np.array([len(s) for s, _ in best])
            ids = mine.column("query_id").take(pa.array(np.repeat(np.arange(len(q)), counts)))
            places = np.concatenate([p for _, p in best])
            domain = pa.nulls(len(places), arrow.field("pfam_id").type).fill_null(pfam)
            found.append(pa.table([domain, ids, right.column("target_id").take(pa.array(places)), pa.array(np.concatenate([s for s, _ in best]))], schema=arrow))
        return pa.concat_tables(found) if found else nothing

    blocked = left.withColumn("block", every(blocks)).groupBy("unit", "block")
    scored = blocked.cogroup(right.groupBy("unit", "block")).applyInArrow(score, out)
    return top_n(scored, ["pfam_id", "query_id"], order("-bsi_score", "target_id"), per_seed)


def learned_scores(
    seeds: DataFrame, targets: DataFrame, models: DataFrame | dict[str, Network], dim: int, threshold: float = 0.5, per_seed: int | None = 1000, top: int | None = 10_000, **blocks: int
) -> DataFrame:
    """uniprot_id, pfam_id, query_id, target_id, bsi_score of at least the threshold.

    seeds: uniprot_id, pfam_id, query_id, words, any number; those whose domain has no model give nothing, and one that
    proteins share is scored once.  targets: target_id, words.  Each seed keeps its best ``per_seed`` targets, each
    protein's targets their best seed, and of these the best ``top`` stay.
    """
    table = model_table(seeds.sparkSession, models) if isinstance(models, dict) else models
    found = score_blocks(seeds, targets, table, dim, threshold, per_seed, **blocks)
    hits = seeds.select("uniprot_id", "pfam_id", "query_id").distinct().join(found, ["pfam_id", "query_id"])
    best = keep_first(hits, ["uniprot_id", "target_id"], order("-bsi_score", "query_id", "pfam_id"))
    kept = top_n(best, ["uniprot_id"], order("-bsi_score", "query_id", "target_id"), top)
    return kept.select("uniprot_id", "pfam_id", "query_id", "target_id", "bsi_score")
