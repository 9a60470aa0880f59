"""Candidate proteins of each query by three methods: strict sequence hits, nearest k, shared domains.

hits: qseqid, sseqid, pident, length, qlen, slen, evalue, bitscore and the columns of a tie key.
domain hits: qseqid, pfam_id (or pfam_acc), dom_score, dom_i_evalue.  protein domains: uniprot_id, pfam_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .ranking import keep_first, order, top_n

#: Queries whose domains are sent to the hits (some hundred bytes each).
FEW_QUERIES = 500_000
PAIR = ["qseqid", "sseqid"]
EVIDENCE = ["bitscore", "evalue", "pident", "qcov", "scov"]
STRONGEST = ["-bitscore", "evalue", "-pident", "-qcov", "-scov"]


def method_rank(column: str = "search_type") -> Column:
    """sequence before nearest_k before domain."""
    c = F.col(column)
    return F.when(c == "sequence", 0).when(c == "nearest_k", 1).when(c == "domain", 2)


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def with_coverage(hits: DataFrame) -> DataFrame:
    """qcov and scov: aligned length, gaps included, over each sequence's (so above 1 at times)."""
    return hits.withColumns({"qcov": ratio("length", "qlen"), "scov": ratio("length", "slen")})


def strict_hits(
    hits: DataFrame, min_identity: float = 0.9, min_query_coverage: float = 0.9, min_subject_coverage: float = 0.7, evalue_max: float = 1e-5
) -> DataFrame:
    """Hits that meet all four limits, each inclusive."""
    return with_coverage(hits).where(
        (F.col("pident") / 100.0 >= min_identity)
        & (F.col("qcov") >= min_query_coverage)
        & (F.col("scov") >= min_subject_coverage)
        & (F.col("evalue") <= evalue_max)
    )


def sequence_candidates(hits: DataFrame, tie: list[str], max_hits: int | None = 150, **limits: float) -> DataFrame:
    """The strongest ``max_hits`` strict hit rows of each query, then the best one per pair."""
    by = order(*STRONGEST, "sseqid", *tie)
    best = top_n(strict_hits(hits, **limits), ["qseqid"], by, max_hits)
    return keep_first(best, PAIR, by).select(*PAIR, *EVIDENCE, F.lit("sequence").alias("search_type"))


def best_hit_per_pair(hits: DataFrame, tie: list[str]) -> DataFrame:
    return keep_first(with_coverage(hits), PAIR, order(*STRONGEST, *tie)).select(*PAIR, *EVIDENCE)


def nearest_pool(ranked_hits: DataFrame, sequence: DataFrame | None) -> DataFrame:
    """Best hits without the pairs that are sequence candidates already."""
    pool = ranked_hits if sequence is None else ranked_hits.join(sequence.select(*PAIR), PAIR, "left_anti")
    return pool.withColumn("search_type", F.lit("nearest_k"))


def query_domains(domain_hits: DataFrame, evalue_max: float | None = None) -> DataFrame:
    """(qseqid, pfam_id), distinct; versions such as PF00069.20 lose their suffix."""
    df = domain_hits if evalue_max is None else domain_hits.where(F.col("dom_i_evalue") <= evalue_max)
    if "pfam_id" not in df.columns:
        df = df.withColumn("pfam_id", F.substring_index("pfam_acc", ".", 1))
    return df.where("qseqid is not null and pfam_id is not null").select("qseqid", "pfam_id").distinct()


def sharing_hits(hits: DataFrame, domains: DataFrame, domain_hits: DataFrame) -> DataFrame:
    """Hits whose protein has a domain of their query: all that nearest k and the shared domains ever take, so that the other
    hits need not be ranked.  Each hit meets the list of its protein's domains (those that some query has) and of its query's."""
    wanted = query_domains(domain_hits)
    mine = materialize(wanted.groupBy("qseqid").agg(F.collect_set("pfam_id").alias("__of_query")), "query-domains")
    asked = mine.select(F.explode("__of_query").alias("pfam_id")).distinct()
    proteins = domains.select(F.col("uniprot_id").alias("sseqid"), "pfam_id").join(asked, "pfam_id", "left_semi")
    of = proteins.groupBy("sseqid").agg(F.collect_set("pfam_id").alias("__of_protein"))
    few = F.broadcast(mine) if mine.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES else mine
    both = hits.join(of, "sseqid").join(few, "qseqid")
    return both.where(F.arrays_overlap("__of_query", "__of_protein")).select(*hits.columns)


def nearest_k(pool: DataFrame, domains: DataFrame, domain_hits: DataFrame, k: int | None = 5, shared: bool = False) -> DataFrame:
    """Of each query's pool, proteins that share a domain with it; the strongest k.  The pool's pairs are looked up, so a
    domain of many proteins and queries makes no more rows than the pool has.  shared: the pool has no other pairs
    (``sharing_hits``)."""
    if shared:
        return top_n(pool, ["qseqid"], order(*STRONGEST, "sseqid"), k)
    proteins = domains.select(F.col("uniprot_id").alias("sseqid"), "pfam_id")
    shared = pool.select(*PAIR).join(proteins, "sseqid").join(query_domains(domain_hits), ["qseqid", "pfam_id"], "left_semi").select(*PAIR)
    return top_n(pool.join(shared, PAIR, "left_semi"), ["qseqid"], order(*STRONGEST, "sseqid"), k)


def best_domain_evidence(domain_hits: DataFrame) -> DataFrame:
    """Per query and domain the highest score and the lowest e-value."""
    return domain_hits.groupBy("qseqid", "pfam_id").agg(F.max("dom_score").alias("best_domain_score"), F.min("dom_i_evalue").alias("best_domain_evalue"))


def domain_top_n(domain_hits: DataFrame, domains: DataFrame, ranked_hits: DataFrame, n: int = 20) -> DataFrame:
    """Per query and domain the n proteins with that domain that the query's hits rank highest, proteins without a hit
    behind them by id.

    Of the latter only the first 2n proteins of a domain can be among the n: fewer than n rows with evidence and fewer than
    n without it stand before such a protein.  So a domain of many proteins does not meet all queries that have it.  And
    they are made only for those queries and domains that fewer than n hits with a score belong to."""
    if n <= 0:
        raise ValueError("n must be positive")
    key = ["qseqid", "pfam_id"]
    proteins = domains.select(F.col("uniprot_id").alias("sseqid"), "pfam_id").where("sseqid is not null").distinct()
    evidence, hits = materialize(best_domain_evidence(domain_hits), "evidence"), ranked_hits.select(*PAIR, *EVIDENCE)
    by = order("-has_blast_hit", *STRONGEST, "-best_domain_score", "best_domain_evalue", "sseqid")
    asked = proteins.join(evidence.select("pfam_id").distinct(), "pfam_id", "left_semi")
    matched = hits.join(asked, "sseqid").join(evidence, key).withColumn("has_blast_hit", F.col("bitscore").isNotNull())
    matched = materialize(top_n(matched, key, by, n), "matched")
    full = matched.where("has_blast_hit").groupBy(*key).count().where(F.col("count") >= n).select(*key)
    first = top_n(asked, ["pfam_id"], order("sseqid"), 2 * n)
    others = evidence.join(full, key, "left_anti").join(first, "pfam_id").join(hits.select(*PAIR), PAIR, "left_anti").withColumn("has_blast_hit", F.lit(False))
    kept = matched.join(full, key, "left_semi").unionByName(top_n(matched.join(full, key, "left_anti").unionByName(others, allowMissingColumns=True), key, by, n), allowMissingColumns=True)
    return kept.select("qseqid", "sseqid", "pfam_id", "best_domain_score", "best_domain_evalue", *EVIDENCE, "has_blast_hit")


def domain_candidates(per_domain: DataFrame) -> DataFrame:
    """One row per pair: how many of its domains are left, and the best of each kind of evidence."""
    return per_domain.groupBy(*PAIR).agg(
        F.countDistinct("pfam_id").alias("n_shared_domains"), F.bool_or("has_blast_hit").alias("has_blast_hit"),
        F.max("bitscore").alias("bitscore"), F.min("evalue").alias("evalue"), F.max("pident").alias("pident"), F.max("qcov").alias("qcov"),
        F.max("scov").alias("scov"), F.max("best_domain_score").alias("best_domain_score"), F.min("best_domain_evalue").alias("best_domain_evalue"),
    ).withColumn("search_type", F.lit("domain"))


def combine(*methods: DataFrame) -> DataFrame:
    """All methods' candidates; a pair found by several keeps the row of the first method."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), methods)
    return keep_first(union.withColumn("__m", method_rank()), PAIR, [F.asc("__m"), *order(*STRONGEST)]).drop("__m")


def with_shared_domains(candidates: DataFrame, domains: DataFrame, domain_hits: DataFrame) -> DataFrame:
    """n_shared_domains: the count a candidate brings along, else its domains that the query has, else 0.  Only candidates
    without a count are looked up."""
    has = "n_shared_domains" in candidates.columns
    rest = candidates.where("n_shared_domains is null").drop("n_shared_domains") if has else candidates
    proteins = domains.select(F.col("uniprot_id").alias("sseqid"), "pfam_id").distinct()
    counts = (
        rest.select(*PAIR).distinct().join(proteins, "sseqid").join(query_domains(domain_hits), ["qseqid", "pfam_id"])
        .groupBy(*PAIR).agg(F.countDistinct("pfam_id").alias("__n"))
    )
    rest = rest.join(counts, PAIR, "left").withColumn("n_shared_domains", F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")
    if not has:
        return rest
    own = candidates.where("n_shared_domains is not null").withColumn("n_shared_domains", F.col("n_shared_domains").cast("long"))
    return own.unionByName(rest.select(*own.columns))
