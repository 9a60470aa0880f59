"""The operators' inputs, laid over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity import bitcount, packed

TIE = ["l_orderkey", "l_linenumber"]
EVALUE_MAX = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("qseqid"), F.col("l_partkey").alias("sseqid"), (F.col("l_quantity") * 2).alias("pident"), F.col("l_quantity").alias("length"),
        F.lit(50.0).alias("qlen"), F.col("p_size").cast("double").alias("slen"), F.col("l_discount").alias("evalue"), F.col("l_extendedprice").alias("bitscore"), *TIE,
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("uniprot_id"), F.explode(F.array("p_brand", "p_type")).alias("pfam_id")).distinct()


def hmmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    strong = li.where("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity >= 48")
    return strong.join(part, strong.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("qseqid"), F.col("p_brand").alias("pfam_id"), F.col("l_quantity").alias("dom_score"), F.col("l_tax").alias("dom_i_evalue")
    )


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qseqid"))


def binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("uniprot_id"), (F.col("l_partkey") % 40).alias("chem_comp_id"), F.col("l_returnflag").alias("pfam_id"), F.col("l_linestatus").alias("source"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("pdb_id"), F.when(F.col("l_quantity") >= 25, F.col("l_quantity") / 5).alias("pchembl"),
        F.when(F.col("l_tax") >= 0.06, F.concat(F.lit("M"), F.col("l_linenumber").cast("string"))).alias("mechanism"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").alias("ord"),
    )


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligands 0..34 have a structure, 35..39 none."""
    part = table(spark, sf_dir, "part")
    return part.where("p_partkey < 35").select(F.col("p_partkey").alias("chem_comp_id"), F.col("p_name").alias("smiles"))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, words, bitcount: the signs of the embeddings."""
    df = table(spark, sf_dir, "embeddings")
    words = packed(F.transform("embedding", lambda x: (x > 0).cast("int")))
    return df.select("vec_id", "label", words.alias("words")).withColumn("bitcount", bitcount(F.col("words")))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound data by index; several indexes have the same compound."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("lig_idx"), (F.col("vec_id") % 150).alias("chem_comp_id"), F.concat(F.lit("S"), F.col("label").cast("string")).alias("smiles"))


_BY = "bitscore DESC NULLS LAST, evalue ASC NULLS LAST, pident DESC NULLS LAST, qcov DESC NULLS LAST, scov DESC NULLS LAST"
_TIE = "l_orderkey, l_linenumber"

#: The same in DuckDB SQL, as named subqueries.
SQL = {
    "hits": "SELECT l_suppkey AS qseqid, l_partkey AS sseqid, l_quantity * 2 AS pident, l_quantity AS length, 50.0::DOUBLE AS qlen, p_size::DOUBLE AS slen, "
    "l_discount AS evalue, l_extendedprice AS bitscore, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey",
    "covered": "SELECT *, length / qlen AS qcov, CASE WHEN slen > 0 THEN length / slen END AS scov FROM hits",
    "strict": f"SELECT * FROM covered WHERE pident / 100.0::DOUBLE >= 0.9 AND qcov >= 0.9 AND scov >= 0.7 AND evalue <= {EVALUE_MAX}",
    "seq": f"SELECT qseqid, sseqid, bitscore, evalue, pident, qcov, scov, 'sequence' AS search_type FROM (SELECT * FROM strict QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY {_BY}, sseqid, {_TIE}) <= 150) "
    f"QUALIFY row_number() OVER (PARTITION BY qseqid, sseqid ORDER BY {_BY}, {_TIE}) = 1",
    "best": f"SELECT qseqid, sseqid, bitscore, evalue, pident, qcov, scov FROM covered QUALIFY row_number() OVER (PARTITION BY qseqid, sseqid ORDER BY {_BY}, {_TIE}) = 1",
    "pool": "SELECT *, 'nearest_k' AS search_type FROM best ANTI JOIN seq USING (qseqid, sseqid)",
    "doms": "SELECT p_partkey AS uniprot_id, p_brand AS pfam_id FROM part UNION SELECT p_partkey, p_type FROM part",
    "hmm": "SELECT l_suppkey AS qseqid, p_brand AS pfam_id, l_quantity AS dom_score, l_tax AS dom_i_evalue FROM lineitem JOIN part ON l_partkey = p_partkey "
    "WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 48",
    "near": "SELECT * FROM pool p WHERE EXISTS (SELECT 1 FROM doms d JOIN hmm h ON h.pfam_id = d.pfam_id WHERE d.uniprot_id = p.sseqid AND h.qseqid = p.qseqid) "
    f"QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY {_BY}, sseqid) <= 5",
    "evidence": "SELECT qseqid, pfam_id, max(dom_score) AS best_domain_score, min(dom_i_evalue) AS best_domain_evalue FROM hmm GROUP BY ALL",
    "perdom": "SELECT e.qseqid, d.uniprot_id AS sseqid, e.pfam_id, best_domain_score, best_domain_evalue, bitscore, evalue, pident, qcov, scov, bitscore IS NOT NULL AS has_blast_hit "
    "FROM evidence e JOIN doms d USING (pfam_id) LEFT JOIN best b ON b.qseqid = e.qseqid AND b.sseqid = d.uniprot_id "
    f"QUALIFY row_number() OVER (PARTITION BY e.qseqid, e.pfam_id ORDER BY (bitscore IS NOT NULL) DESC, {_BY}, best_domain_score DESC NULLS LAST, best_domain_evalue ASC NULLS LAST, d.uniprot_id) <= 20",
    "domcand": "SELECT qseqid, sseqid, count(DISTINCT pfam_id) AS n_shared_domains, bool_or(has_blast_hit) AS has_blast_hit, max(bitscore) AS bitscore, min(evalue) AS evalue, max(pident) AS pident, "
    "max(qcov) AS qcov, max(scov) AS scov, max(best_domain_score) AS best_domain_score, min(best_domain_evalue) AS best_domain_evalue, 'domain' AS search_type FROM perdom GROUP BY qseqid, sseqid",
    "combined": "SELECT * FROM (SELECT * FROM seq UNION ALL BY NAME SELECT * FROM near UNION ALL BY NAME SELECT * FROM domcand) QUALIFY row_number() OVER (PARTITION BY qseqid, sseqid ORDER BY "
    "CASE search_type WHEN 'sequence' THEN 0 WHEN 'nearest_k' THEN 1 ELSE 2 END) = 1",
    "shared": "SELECT qseqid, sseqid, count(DISTINCT pfam_id) AS n FROM (SELECT DISTINCT qseqid, sseqid FROM combined) c JOIN doms d ON d.uniprot_id = c.sseqid JOIN (SELECT DISTINCT qseqid, pfam_id FROM hmm) h USING (qseqid, pfam_id) GROUP BY ALL",
    "cand": "SELECT c.* REPLACE (coalesce(c.n_shared_domains, s.n, 0)::BIGINT AS n_shared_domains) FROM combined c LEFT JOIN shared s USING (qseqid, sseqid)",
    "ranking": "SELECT qseqid, sseqid, search_type, row_number() OVER (PARTITION BY qseqid ORDER BY CASE search_type WHEN 'sequence' THEN 0 WHEN 'nearest_k' THEN 1 ELSE 2 END, (bitscore IS NOT NULL) DESC, "
    f"{_BY}, best_domain_score DESC NULLS LAST, best_domain_evalue ASC NULLS LAST, n_shared_domains DESC NULLS LAST, sseqid) AS protein_rank, "
    "CASE WHEN bitscore IS NOT NULL THEN 'blast' WHEN best_domain_score IS NOT NULL OR best_domain_evalue IS NOT NULL THEN 'domain' ELSE '' END AS ranking_source, bitscore AS blast_bitscore, "
    "evalue AS blast_evalue, pident AS blast_pident, qcov AS blast_qcov, scov AS blast_scov, best_domain_score, best_domain_evalue, n_shared_domains FROM cand",
    "kb": "SELECT l_suppkey AS uniprot_id, l_partkey % 40 AS chem_comp_id, l_returnflag AS pfam_id, l_linestatus AS source, 'L' || l_linenumber AS pdb_id, CASE WHEN l_quantity >= 25 THEN l_quantity / 5 END AS pchembl, "
    "CASE WHEN l_tax >= 0.06 THEN 'M' || l_linenumber END AS mechanism, row(l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity) AS ord FROM lineitem",
    "bydom0": "SELECT uniprot_id, chem_comp_id, pfam_id, source, list(pdb_id ORDER BY ord) AS l, max(pchembl) AS pchembl, arg_min(mechanism, ord) FILTER (WHERE mechanism IS NOT NULL) AS mechanism FROM kb GROUP BY ALL",
    "bydom": "SELECT uniprot_id, chem_comp_id, pfam_id, source, list_filter(l, lambda x, i: list_position(l, x) = i) AS pdb_ids, pchembl, mechanism FROM bydom0",
    "sites0": "SELECT uniprot_id, chem_comp_id, source, list(pfam_id ORDER BY pfam_id) AS binding_sites, flatten(list(pdb_ids ORDER BY pfam_id)) AS l, max(pchembl) AS pchembl, "
    "arg_min(mechanism, pfam_id) FILTER (WHERE mechanism IS NOT NULL) AS mechanism FROM bydom GROUP BY ALL",
    "known": "SELECT s.uniprot_id, s.chem_comp_id, s.source, binding_sites, list_filter(l, lambda x, i: list_position(l, x) = i) AS pdb_ids, pchembl, mechanism, p_name AS smiles FROM sites0 s JOIN part ON p_partkey = chem_comp_id WHERE p_partkey < 35",
    "pairs": "SELECT c.qseqid, c.sseqid, c.search_type, k.chem_comp_id, k.source, k.pchembl FROM cand c JOIN known k ON k.uniprot_id = c.sseqid",
    "collapsed": "SELECT p.qseqid, p.sseqid, p.search_type, p.chem_comp_id, p.source, p.pchembl, protein_rank FROM pairs p JOIN ranking r USING (qseqid, sseqid) "
    "QUALIFY row_number() OVER (PARTITION BY p.qseqid, p.chem_comp_id ORDER BY protein_rank, CASE p.search_type WHEN 'sequence' THEN 0 WHEN 'nearest_k' THEN 1 ELSE 2 END, p.source) = 1",
    "contrib": "SELECT r.* REPLACE (row_number() OVER (PARTITION BY qseqid ORDER BY protein_rank) AS protein_rank) FROM ranking r SEMI JOIN collapsed USING (qseqid, sseqid)",
    "bits": "SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings",
    "nbits": "SELECT vec_id, label, b, list_sum(b) AS n FROM bits",
    "tani": "SELECT x.vec_id AS query_id, y.vec_id AS target_id, x.label AS q_label, y.label AS t_label, list_inner_product(x.b::DOUBLE[], y.b::DOUBLE[]) AS s, x.n AS nx, y.n AS ny, "
    "CASE WHEN x.n + y.n - s > 0 THEN s / (x.n + y.n - s) ELSE 0 END AS tanimoto FROM nbits x, nbits y",
    "library": "SELECT vec_id AS lig_idx, vec_id % 150 AS chem_comp_id, 'S' || label AS smiles FROM embeddings",
    "seedhits": "SELECT k.uniprot_id, target_id, query_id, tanimoto FROM (SELECT DISTINCT uniprot_id, chem_comp_id FROM known) k JOIN tani ON query_id = k.chem_comp_id WHERE tanimoto >= 0.45 "
    "QUALIFY row_number() OVER (PARTITION BY k.uniprot_id ORDER BY tanimoto DESC, query_id, target_id) <= 60",
    "targethits": "SELECT * FROM seedhits QUALIFY row_number() OVER (PARTITION BY uniprot_id, target_id ORDER BY tanimoto DESC, query_id) = 1",
    "named": "SELECT uniprot_id, 'Z' || chem_comp_id AS chem_comp_id, smiles, query_id, tanimoto FROM targethits JOIN library ON lig_idx = target_id "
    "QUALIFY row_number() OVER (PARTITION BY uniprot_id, library.chem_comp_id, smiles ORDER BY tanimoto DESC, query_id, target_id) = 1",
    "predicted": "SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY uniprot_id ORDER BY tanimoto DESC, query_id, chem_comp_id, smiles) <= 25",
    "ppairs": "SELECT c.qseqid, c.sseqid, c.search_type, p.chem_comp_id, p.smiles, p.query_id, p.tanimoto FROM cand c JOIN predicted p ON p.uniprot_id = c.sseqid",
    "pcollapsed": "SELECT p.*, protein_rank FROM ppairs p JOIN ranking r USING (qseqid, sseqid) QUALIFY row_number() OVER (PARTITION BY p.qseqid, p.chem_comp_id ORDER BY protein_rank, "
    "CASE p.search_type WHEN 'sequence' THEN 0 WHEN 'nearest_k' THEN 1 ELSE 2 END, tanimoto DESC, query_id, smiles) = 1",
    "named_by_ligands": "SELECT r.* FROM ranking r SEMI JOIN (SELECT qseqid, sseqid FROM collapsed UNION SELECT qseqid, sseqid FROM pcollapsed) USING (qseqid, sseqid)",
}


def with_views(body: str) -> str:
    """The statement with the named subqueries that it needs, in order."""
    import re

    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(SQL[name])
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in needed)
    if not ctes:
        return body
    return f"WITH {ctes}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
