"""Registered queries of operators 11 to 13, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.bit_planes import cluster_vectors
from cohortflow.llm.merkle import manifest
from cohortflow.llm.registry import fold, query, table
from cohortflow.llm.toxicity import fit_toxicity, toxic_clauses


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q
  FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v WHERE vec_id IS NOT NULL
        ORDER BY h, q LIMIT {k})
)""",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""a{t} AS MATERIALIZED (
  SELECT r, vec_id, vq, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
      SELECT v.r, v.vec_id, v.q AS vq, m.c,
             CAST(list_sum(list_transform(list_zip(v.q, m.q),
                  lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
      FROM v CROSS JOIN c{t} m)) WHERE place = 1
)"""
        )
        if t < rounds:
            parts.append(
                f"""c{t + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(g.q, m.q) AS q FROM c{t} m LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n
      FROM (SELECT c, unnest(vq) AS x, unnest(range(64)) AS i FROM a{t}) GROUP BY c, i)
    GROUP BY c) g ON m.c = g.c
)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c"""


@query("op11_centroid_clusters", _clusters_sql())
def centroid_clusters(spark: SparkSession, base: str) -> DataFrame:
    return cluster_vectors(table(spark, base, "embeddings"))


FANOUT = 8


def _manifest_sql(levels: int = 7, top_levels: int = 2) -> str:
    """Whole lists of digests per language and level; enough levels for 8^7 leaves and 8^2 languages."""

    def up(nodes: str) -> str:
        return (
            f"CASE WHEN len({nodes}) = 1 THEN {nodes} ELSE list_transform("
            f"range(0, len({nodes}), {FANOUT}), lambda i: "
            f"sha256(array_to_string({nodes}[i + 1:i + {FANOUT}], ''))) END"
        )

    def siblings(nodes: str, at: str) -> tuple[str, str]:
        first = f"({at}) // {FANOUT} * {FANOUT}"
        low = f"array_to_string({nodes}[{first} + 1:{at}], '')"
        high = f"array_to_string({nodes}[({at}) + 2:{first} + {FANOUT}], '')"
        return low, high

    def text(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        return f"coalesce(strlen({v}) || ':' || {v}, '-')"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(map(text, ("doc_id", "source", "lang", "n_chars")))
    # One step of the checksum takes a byte in, eight more shift it out.
    crc = (
        "xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform("
        "string_split(CAST(doc_id AS VARCHAR), ''), lambda c: "
        "list_concat([CAST(ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))), "
        "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) "
        "ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    )
    parts = [
        f"""d AS (
  SELECT doc_id, lang, sha256({head} || {text("text")}) AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {text(lower)}) END AS other
  FROM documents
)""",
        """p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
)""",
        "n0 AS (SELECT lang, list(leaf ORDER BY pos) AS l0 FROM p GROUP BY lang)",
    ]
    for k in range(levels):
        parts.append(f"n{k + 1} AS MATERIALIZED (SELECT *, {up(f'l{k}')} AS l{k + 1} FROM n{k})")
    parts.append(
        f"g AS MATERIALIZED (SELECT *, l{levels}[1] AS subroot, "
        f"row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM n{levels})"
    )
    parts.append("t0 AS (SELECT list(subroot ORDER BY place) AS t0 FROM g)")
    for k in range(top_levels):
        parts.append(f"t{k + 1} AS MATERIALIZED (SELECT *, {up(f't{k}')} AS t{k + 1} FROM t{k})")
    proof, folds = [], ["coalesce(other, leaf) AS f0"]
    steps = [(f"l{k}", f"pos // {FANOUT**k}") for k in range(levels)]
    steps += [(f"t{k}", f"place // {FANOUT**k}") for k in range(top_levels)]
    for i, (nodes, at) in enumerate(steps):
        low, high = siblings(nodes, at)
        proof.append(f"CASE WHEN len({nodes}) > 1 THEN {low} || {high} ELSE '' END")
        folds.append(
            f"CASE WHEN len({nodes}) > 1 THEN sha256({low} || f{i} || {high}) ELSE f{i} END AS f{i + 1}"
        )
    last = f"f{len(steps)}"
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified
FROM (
  SELECT p.doc_id, leaf, subroot, t{top_levels}[1] AS root,
         sha256({" || ".join(proof)}) AS proof_sha256, {", ".join(folds)}
  FROM p JOIN g ON p.lang IS NOT DISTINCT FROM g.lang CROSS JOIN t{top_levels})"""


@query("op13_merkle_manifest", _manifest_sql())
def merkle_manifest(spark: SparkSession, base: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(table(spark, base, "documents"), tampered=hit)


@query("op12_toxicity")
def toxicity(spark: SparkSession, base: str) -> DataFrame:
    docs, labels = table(spark, base, "documents"), table(spark, base, "labels")
    model = fit_toxicity(docs, labels.where(~fold(4, 2)))
    return toxic_clauses(docs, model).select(
        "doc_id",
        fold(4, 2).alias("held_out"),
        "score",
        "predicted",
        F.size("clauses").cast("bigint").alias("n_clauses"),
    )
