"""Registered queries and the SQL they must agree with.

``queries()`` runs every operator of the library over the whole Parquet tables
of a folder; ``oracle_sql()`` states the same results as SQL over the same
tables. Doubles are rounded on both sides, because sums may be taken in any
order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountgraph import schemas
from accountgraph.functions.geometry import squared_array_distance
from accountgraph.operators import clustering, generate, graph, pagerank, text, visits
from accountgraph.plans import jobs
from accountgraph.sinks import files
from accountgraph.sources import tables
from accountgraph.sources import text as text_source
from accountgraph.storage import pin, scratch_path

try:  # the corpus operators are a part that may be left out
    import corpus_pipeline
    from accountgraph.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "accountgraph.llm"):
        raise  # they are there, but broken
    corpus_pipeline = llm_queries = None

SMOKE_FOLDER = "/root/testdata/sf0.001"

# Period of the visit queries (exclusive epoch seconds): 2024-01-08 to 2024-01-22 UTC.
AFTER = 1704672000
BEFORE = 1705881600
NEEDLE = "data"
DAMPING = 0.85
ROUNDS = 10
SEED = 42
K = 5
MANY = 250
DIMENSIONS = 64


# ---------------------------------------------------------------- text files


def _as_text_lines(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as space-separated text and read back as lines."""
    path = scratch_path(df.sparkSession, name)
    files.write_text(df, path)
    return text_source.read_lines(df.sparkSession, path)


def text_scan_edges(spark: SparkSession, folder: str) -> DataFrame:
    return text_source.parse_edges(_as_text_lines(tables.edges(spark, folder), "edges"))


def text_scan_weblog(spark: SparkSession, folder: str) -> DataFrame:
    return text_source.parse_visits(_as_text_lines(tables.web_log(spark, folder), "web-log"))


def text_scan_rank(spark: SparkSession, folder: str) -> DataFrame:
    return text_source.parse_ranks(_as_text_lines(tables.page_rank(spark, folder), "ranks"))


def text_scan_points(spark: SparkSession, folder: str) -> DataFrame:
    degrees = graph.degree_table(tables.edges(spark, folder))
    return text_source.parse_points(_as_text_lines(degrees, "points"))


def text_scan_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return text_source.parse_centroids(_as_text_lines(_as_centroids(_points(spark, folder)), "centroids"))


def text_scan_vectors(spark: SparkSession, folder: str) -> DataFrame:
    degrees = graph.degree_table(tables.edges(spark, folder))
    parsed = text_source.parse_vectors(_as_text_lines(degrees, "vectors"))
    return parsed.select(*[F.col("features")[i].alias(f"v{i}") for i in range(3)])


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return text_source.parse_ids(_as_text_lines(tables.edges(spark, folder), "tokens")).distinct()


def line_count(spark: SparkSession, folder: str) -> DataFrame:
    return text.count_lines(tables.lines(spark, folder))


def grep_count(spark: SparkSession, folder: str) -> DataFrame:
    return text.count_occurrences(tables.lines(spark, folder), NEEDLE)


# ------------------------------------------------------------------ visit log


def weblog_time_filter(spark: SparkSession, folder: str) -> DataFrame:
    return visits.in_period(tables.web_log(spark, folder, AFTER, BEFORE), AFTER, BEFORE)


def weblog_ip_counts(spark: SparkSession, folder: str) -> DataFrame:
    return visits.ip_counts(tables.web_log(spark, folder))


def weblog_top_ip(spark: SparkSession, folder: str) -> DataFrame:
    return visits.top_ip(tables.web_log(spark, folder))


def weblog_of_top_ip(spark: SparkSession, folder: str) -> DataFrame:
    return visits.visits_of_top_ip(tables.web_log(spark, folder))


def weblog_join_top_ip(spark: SparkSession, folder: str) -> DataFrame:
    return visits.join_top_ip(tables.web_log(spark, folder))


def rank_weblog_join(spark: SparkSession, folder: str) -> DataFrame:
    return visits.rank_visits(tables.page_rank(spark, folder), tables.web_log(spark, folder))


def join_task(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.web_log(spark, folder, AFTER, BEFORE)
    average = visits.top_visitor_avg_rank(tables.page_rank(spark, folder), log, AFTER, BEFORE)
    return average.select(F.round("avg_page_rank", 6).alias("avg_page_rank"))


def join_task_sum_count(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.web_log(spark, folder, AFTER, BEFORE)
    average = visits.top_visitor_avg_rank_by_sum(tables.page_rank(spark, folder), log, AFTER, BEFORE)
    return average.select(F.round("avg_page_rank", 6).alias("avg_page_rank"))


def weblog_generate(spark: SparkSession, folder: str) -> DataFrame:
    return generate.generate_visits(graph.account_ids(tables.edges(spark, folder)), SEED)


# ---------------------------------------------------------------------- graph


def _on_edges(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(tables.edges(spark, folder))


def follower_pursuer_join(spark: SparkSession, folder: str) -> DataFrame:
    # Both counts come from one table that is made once.
    degrees = pin(graph.degree_table(tables.edges(spark, folder)))
    followers = degrees.select("id", F.col("followers").alias("n"))
    return graph.join_degrees(followers, degrees.select("id", F.col("pursuers").alias("n")))


def out_weight_sum(spark: SparkSession, folder: str) -> DataFrame:
    return graph.out_weight_sum(graph.weighted_edges(tables.edges(spark, folder)))


def edge_weights(spark: SparkSession, folder: str) -> DataFrame:
    weights = graph.edge_weights(graph.weighted_edges(tables.edges(spark, folder)))
    return weights.withColumn("weight", F.round("weight", 10))


def _pagerank(rounds: int, init: float | str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ranks = pagerank.pagerank(tables.edges(spark, folder), rounds, DAMPING, init)
        return ranks.select("id", F.round("rank", 10).alias("rank"))

    return query


# -------------------------------------------------------------------- k-means


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return text_source.as_points(graph.degree_table(tables.edges(spark, folder)))


def _as_centroids(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").cast("int").alias("cid"), "x", "y")


def _start(points: DataFrame, k: int = K) -> DataFrame:
    """The points with ids below k as starting centroids."""
    return _as_centroids(points.where(F.col("id") < k))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


def kmeans_assign(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return clustering.assign(points, _start(points)).select("id", "cid")


def kmeans_assign_many(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return clustering.assign(points, _start(points, MANY)).select("id", "cid")


def kmeans_update(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return _rounded(clustering.update(clustering.assign(points, _start(points))))


def kmeans_centroids(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return _rounded(clustering.lloyd(points, _start(points), ROUNDS, merge_places=True).centroids)


def kmeans_points(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return clustering.lloyd(points, _start(points), ROUNDS, merge_places=True).labelled


def kmeans_cost(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    centroids = clustering.lloyd(points, _start(points), ROUNDS, merge_places=True).centroids
    return clustering.within_cluster_cost(points, centroids).select(F.round("cost", 4).alias("cost"))


ACCOUNT_FEATURES = ("id", "followers", "pursuers")


def _seeded_vectors(spark: SparkSession, folder: str) -> clustering.RandomStart:
    return clustering.kmeans_seeded(tables.vectors(spark, folder), K, "embedding", SEED, "vec_id", ROUNDS)


def _seeded_accounts(spark: SparkSession, folder: str) -> clustering.RandomStart:
    degrees = graph.degree_table(tables.edges(spark, folder))
    return clustering.kmeans_seeded(degrees, K, ACCOUNT_FEATURES, SEED, "id", ROUNDS)


def kmeans_seeded_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _seeded_vectors(spark, folder).labelled.select("vec_id", "cid")


def kmeans_seeded_vector_centres(spark: SparkSession, folder: str) -> DataFrame:
    centres = _seeded_vectors(spark, folder).centres
    return centres.select("cid", *[F.round(F.col("embedding")[i], 6).alias(f"f{i}") for i in range(DIMENSIONS)])


def kmeans_seeded_vector_cost(spark: SparkSession, folder: str) -> DataFrame:
    return _seeded_vectors(spark, folder).cost.select("k", F.round("cost", 4).alias("cost"))


def kmeans_seeded_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return _seeded_accounts(spark, folder).labelled.select("id", "cid")


def kmeans_seeded_account_centres(spark: SparkSession, folder: str) -> DataFrame:
    centres = _seeded_accounts(spark, folder).centres
    return centres.select("cid", *[F.round(f, 6).alias(f) for f in ACCOUNT_FEATURES])


def kmeans_seeded_account_cost(spark: SparkSession, folder: str) -> DataFrame:
    return _seeded_accounts(spark, folder).cost.select("k", F.round("cost", 2).alias("cost"))


def _library_vectors(spark: SparkSession, folder: str) -> clustering.RandomStart:
    """The library's rounds from points drawn at random by seeded hash, which SQL can draw too."""
    vectors = tables.vectors(spark, folder)
    start = clustering.random_start(vectors, K, "vec_id", "embedding", SEED)
    return clustering.kmeans_library(vectors, start, "embedding", ROUNDS)


def kmeans_ml_random(spark: SparkSession, folder: str) -> DataFrame:
    return _library_vectors(spark, folder).labelled.select("vec_id", "cluster")


def kmeans_ml_cost(spark: SparkSession, folder: str) -> DataFrame:
    return _library_vectors(spark, folder).cost.select("k", F.round("cost", 4).alias("cost"))


def kmeans_ml_misplaced(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts clustered by the library, and how many of them have a nearer centre (none)."""
    features = ACCOUNT_FEATURES
    degrees = graph.degree_table(tables.edges(spark, folder))
    result = clustering.kmeans_random(degrees, K, features, SEED)
    axes = [F.col("centre")[i] for i in range(3)]
    centroids = result.centres.select(F.col("cluster").alias("cid"), *[a.alias(f) for a, f in zip(axes, features)])
    own = squared_array_distance(F.array(*[F.col(f).cast("double") for f in features]), F.col("centre"))
    measured = clustering.measure(result.labelled, centroids, features).join(F.broadcast(result.centres), "cluster")
    misplaced = F.sqrt(own) > F.col("nearest.distance") * (1 + 1e-6)
    return measured.agg(F.count(F.lit(1)).alias("accounts"), F.count_if(misplaced).alias("misplaced"))


def kmeans_ml_degrees(spark: SparkSession, folder: str) -> DataFrame:
    degrees = graph.degree_table(tables.edges(spark, folder))
    start = clustering.random_start(degrees, K, "id", ACCOUNT_FEATURES, SEED)
    return clustering.kmeans_library(degrees, start, ACCOUNT_FEATURES, ROUNDS).labelled.select("id", "cluster")


# ---------------------------------------------------------------------- sinks


def sink_json(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json")
    files.write_json(tables.web_log(spark, folder), path, mode="overwrite")
    return spark.read.schema(schemas.WEB_LOG).json(path)


def sink_text(spark: SparkSession, folder: str) -> DataFrame:
    return text_source.parse_degrees(
        _as_text_lines(graph.degree_table(tables.edges(spark, folder)), "degrees")
    )


def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    files.write_csv(tables.page_rank(spark, folder), path)
    return spark.read.schema(schemas.PAGE_RANK).option("sep", " ").csv(path)


def sink_single_file(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "single")
    files.write_text(graph.degree_table(tables.edges(spark, folder)), path, single_file=True)
    lines = text_source.read_lines(spark, path)
    parts = lines.select(F.col("_metadata.file_path").alias("part"), "value")
    files_read = parts.agg(F.count_distinct("part")).scalar()
    return text_source.parse_degrees(lines).withColumn("files", files_read)


# ----------------------------------------------------------------------- jobs


def _text_file(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    files.write_text(df, path)
    return path


def job_grep(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "grep")
    jobs.grep(spark, _text_file(tables.lines(spark, folder), "lines"), NEEDLE, out, "json")
    return spark.read.schema("n bigint").json(out)


def job_line_count(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "line-count")
    jobs.line_count(spark, _text_file(tables.web_log(spark, folder), "web-log"), out)
    return text_source.read_lines(spark, out).select(F.col("value").cast("bigint").alias("n"))


def job_neighbour_sums(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "sums")
    jobs.neighbour_sums(spark, _text_file(tables.edges(spark, folder), "edges"), out)
    sums = text_source.parse_edges(text_source.read_lines(spark, out))
    return sums.select(F.col("src").alias("id"), F.col("dst").alias("id_sum"))


def job_degree_files(spark: SparkSession, folder: str) -> DataFrame:
    """The three files of one job, read back: which file, and its numbers."""
    out = scratch_path(spark, "degree-files")
    names = ("both", "followers", "pursuers")
    jobs.degree_files(spark, _text_file(tables.edges(spark, folder), "edges"), *[f"{out}/{n}" for n in names])
    found = None
    for name in names:
        fields = F.split("value", " ")
        numbers = [F.try_element_at(fields, F.lit(i + 1)).cast("bigint").alias(c) for i, c in enumerate(("id", "first", "second"))]
        part = text_source.read_lines(spark, f"{out}/{name}").select(F.lit(name).alias("file"), *numbers)
        found = part if found is None else found.union(part)
    return found


def job_top_visitor_rank(spark: SparkSession, folder: str) -> DataFrame:
    ranks, log = _text_file(tables.page_rank(spark, folder), "ranks"), _text_file(tables.web_log(spark, folder), "web-log")
    out = scratch_path(spark, "average")
    jobs.top_visitor_rank(spark, ranks, log, out, AFTER, BEFORE)
    return spark.read.schema("avg_page_rank double").json(out).select(F.round("avg_page_rank", 6).alias("avg_page_rank"))


def job_lloyd_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """Both files of the job, read back: which file, cluster and coordinates."""
    degrees = graph.degree_table(tables.edges(spark, folder))
    points, start = _text_file(degrees, "points"), _text_file(_start(text_source.as_points(degrees)), "centroids")
    out = scratch_path(spark, "lloyd")
    jobs.lloyd_kmeans(spark, points, start, out, ROUNDS)
    found = None
    for name in ("points", "centroids"):
        part = spark.read.schema("cid int, x double, y double").option("sep", " ").csv(f"{out}_{name}")
        part = _rounded(part).select(F.lit(name).alias("file"), "*")
        found = part if found is None else found.union(part)
    return found


def job_page_ranks(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "ranks")
    jobs.page_ranks(spark, _text_file(tables.edges(spark, folder), "edges"), ROUNDS, DAMPING, out)
    ranks = text_source.parse_ranks(text_source.read_lines(spark, out))
    return ranks.select(F.col("account_id").alias("id"), F.round("page_rank", 10).alias("rank"))


def job_visit_log(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "visits")
    jobs.visit_log(spark, _text_file(tables.edges(spark, folder), "edges"), out, SEED)
    return text_source.parse_visits(text_source.read_lines(spark, out))


# ------------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """Average rank of the accounts visited by the busiest address of the period."""
    return join_task(spark, SMOKE_FOLDER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    extra = {} if llm_queries is None else llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return extra | {
        "text_scan_edges": text_scan_edges,
        "text_scan_weblog": text_scan_weblog,
        "text_scan_rank": text_scan_rank,
        "text_scan_points": text_scan_points,
        "text_scan_centroids": text_scan_centroids,
        "text_scan_vectors": text_scan_vectors,
        "token_ids": token_ids,
        "line_count": line_count,
        "grep_count": grep_count,
        "weblog_time_filter": weblog_time_filter,
        "weblog_ip_counts": weblog_ip_counts,
        "weblog_top_ip": weblog_top_ip,
        "weblog_of_top_ip": weblog_of_top_ip,
        "weblog_join_top_ip": weblog_join_top_ip,
        "rank_weblog_join": rank_weblog_join,
        "join_task": join_task,
        "join_task_sum_count": join_task_sum_count,
        "weblog_generate": weblog_generate,
        "account_ids": _on_edges(graph.account_ids),
        "in_degree": _on_edges(graph.in_degree),
        "out_degree": _on_edges(graph.out_degree),
        "follower_count": _on_edges(graph.follower_count),
        "pursuer_count": _on_edges(graph.pursuer_count),
        "follower_pursuer_count": _on_edges(graph.degree_table),
        "follower_pursuer_join": follower_pursuer_join,
        "neighbour_id_sum": _on_edges(graph.neighbour_id_sum),
        "weighted_edges": _on_edges(graph.weighted_edges),
        "vertex_init": _on_edges(graph.vertex_init),
        "out_weight_sum": out_weight_sum,
        "edge_weights": edge_weights,
        "pagerank_1": _pagerank(1, 1.0),
        "pagerank_10": _pagerank(ROUNDS, 1.0),
        "pagerank_10_uniform": _pagerank(ROUNDS, "uniform"),
        "kmeans_assign": kmeans_assign,
        "kmeans_assign_many": kmeans_assign_many,
        "kmeans_update": kmeans_update,
        "kmeans_centroids": kmeans_centroids,
        "kmeans_points": kmeans_points,
        "kmeans_cost": kmeans_cost,
        "kmeans_seeded_vectors": kmeans_seeded_vectors,
        "kmeans_seeded_vector_centres": kmeans_seeded_vector_centres,
        "kmeans_seeded_vector_cost": kmeans_seeded_vector_cost,
        "kmeans_seeded_accounts": kmeans_seeded_accounts,
        "kmeans_seeded_account_centres": kmeans_seeded_account_centres,
        "kmeans_seeded_account_cost": kmeans_seeded_account_cost,
        "kmeans_ml_random": kmeans_ml_random,
        "kmeans_ml_cost": kmeans_ml_cost,
        "kmeans_ml_degrees": kmeans_ml_degrees,
        "kmeans_ml_misplaced": kmeans_ml_misplaced,
        "sink_json": sink_json,
        "sink_text": sink_text,
        "sink_csv": sink_csv,
        "sink_single_file": sink_single_file,
        "job_grep": job_grep,
        "job_line_count": job_line_count,
        "job_neighbour_sums": job_neighbour_sums,
        "job_degree_files": job_degree_files,
        "job_top_visitor_rank": job_top_visitor_rank,
        "job_lloyd_kmeans": job_lloyd_kmeans,
        "job_page_ranks": job_page_ranks,
        "job_visit_log": job_visit_log,
    }


# ----------------------------------------------------------------- oracle SQL

_EDGES = "edges AS MATERIALIZED (SELECT l_partkey AS src, l_orderkey AS dst FROM lineitem)"
_IDS = "ids AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
_INS = "ins AS MATERIALIZED (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst)"
_OUTS = "outs AS MATERIALIZED (SELECT src AS id, count(*) AS n FROM edges GROUP BY src)"
_DEGREES = """degrees AS MATERIALIZED (
    SELECT ids.id, coalesce(ins.n, 0)::BIGINT AS followers, coalesce(outs.n, 0)::BIGINT AS pursuers
    FROM ids LEFT JOIN ins USING (id) LEFT JOIN outs USING (id))"""
_GRAPH = ", ".join([_EDGES, _IDS, _INS, _OUTS, _DEGREES])

_WEB_LOG = """web_log AS (
    SELECT user_id AS account_id,
           (json_extract_string(props, '$.k')::INTEGER + 1)::INTEGER AS ip,
           floor(epoch(ts))::BIGINT AS ts
    FROM events)"""
_PERIOD = f"period AS (SELECT * FROM web_log WHERE ts > {AFTER} AND ts < {BEFORE})"
_TOP = "top AS (SELECT ip, count(*)::BIGINT AS n FROM {visits} GROUP BY ip ORDER BY n DESC, ip LIMIT 1)"
_OF_TOP = "of_top AS (SELECT * FROM {visits} WHERE ip = (SELECT ip FROM top))"
_RANKS = "ranks AS (SELECT c_custkey AS account_id, c_acctbal AS page_rank FROM customer)"
_VISITS = ", ".join([_WEB_LOG, _PERIOD, _TOP.format(visits="period"), _OF_TOP.format(visits="period"), _RANKS])
_ALL_VISITS = ", ".join([_WEB_LOG, _TOP.format(visits="web_log"), _OF_TOP.format(visits="web_log"), _RANKS])


def _pagerank_sql(rounds: int, start: str) -> str:
    ctes = [
        _EDGES,
        _IDS,
        _OUTS,
        "total AS (SELECT count(*)::DOUBLE AS n FROM ids)",
        f"r0 AS MATERIALIZED (SELECT id, {start} AS rank FROM ids)",
    ]
    for i in range(1, rounds + 1):
        ctes.append(
            f"""r{i} AS MATERIALIZED (
                SELECT ids.id, (1 - {DAMPING}) / (SELECT n FROM total) + {DAMPING} * coalesce(m.inflow, 0) AS rank
                FROM ids LEFT JOIN (
                    SELECT e.dst AS id, sum(r.rank / o.n) AS inflow
                    FROM edges e JOIN r{i - 1} r ON r.id = e.src JOIN outs o ON o.id = e.src
                    GROUP BY e.dst) m ON m.id = ids.id)"""
        )
    return f"WITH {', '.join(ctes)} SELECT id, round(rank, 10) AS rank FROM r{rounds}"


_NEAREST = """{name} AS MATERIALIZED (
    SELECT id, x, y, cid, d FROM (
        SELECT p.id, p.x, p.y, c.cid,
               sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d,
               row_number() OVER (PARTITION BY p.id
                   ORDER BY sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), c.cid) AS place
        FROM points p CROSS JOIN {centroids} c)
    WHERE place = 1)"""
_MEANS = """{name} AS MATERIALIZED (
    SELECT cid, avg(x) AS x, avg(y) AS y, count(*)::BIGINT AS n FROM {labelled} GROUP BY cid)"""


def _kmeans_sql(rounds: int, select: str, k: int = K) -> str:
    """k-means rounds as CTEs: centroids ``c0..``, labels by them ``a0..``."""
    ctes = [
        _GRAPH,
        "points AS MATERIALIZED (SELECT id, followers::DOUBLE AS x, pursuers::DOUBLE AS y FROM degrees)",
        f"c0 AS MATERIALIZED (SELECT id::INTEGER AS cid, x, y FROM points WHERE id < {k})",
    ]
    for i in range(rounds):
        ctes.append(_NEAREST.format(name=f"a{i}", centroids=f"c{i}"))
        ctes.append(_MEANS.format(name=f"c{i + 1}", labelled=f"a{i}"))
    ctes.append(_NEAREST.format(name=f"a{rounds}", centroids=f"c{rounds}"))
    return f"WITH {', '.join(ctes)} {select}"


_EMBEDDED = f"""points AS MATERIALIZED (SELECT vec_id AS id,
    {', '.join(f'embedding[{i + 1}]::DOUBLE AS f{i}' for i in range(DIMENSIONS))} FROM embeddings)"""
_ACCOUNTS = f"""{_GRAPH}, points AS MATERIALIZED (
    SELECT id, id::DOUBLE AS f0, followers::DOUBLE AS f1, pursuers::DOUBLE AS f2 FROM degrees)"""


def _seeded_sql(points: str, n: int, select: str) -> str:
    """k-means over ``n`` features from the K points of the least seeded hashes."""
    features = [f"f{i}" for i in range(n)]
    drawn = f"row_number() OVER (ORDER BY {_hash_sql(2**32, f"'{SEED}:' || id")}, id) - 1"
    ctes = [points, f"c0 AS MATERIALIZED (SELECT * EXCLUDE id FROM (SELECT {drawn} AS cid, * FROM points) WHERE cid < {K})"]
    distance = "sqrt(" + " + ".join(f"(p.{f} - c.{f}) * (p.{f} - c.{f})" for f in features) + ")"
    for i in range(ROUNDS + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
            SELECT * FROM (SELECT p.*, c.cid, {distance} AS d,
                row_number() OVER (PARTITION BY p.id ORDER BY {distance}, c.cid) AS place FROM points p CROSS JOIN c{i} c)
            WHERE place = 1)""")
        means = ", ".join(f"avg({f}) AS {f}" for f in features)
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT cid, {means} FROM a{i} GROUP BY cid)")
    return f"WITH {', '.join(ctes[:-1])} {select}"


def _hash_sql(bound: int, text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {bound})"


def _generate_sql() -> str:
    n = _hash_sql(generate.MAX_VISITS + 1, f"'{SEED}:n:' || id")
    digest = f"('0x' || substr(md5('{SEED}:visit:' || id || ':' || i), 1, 15))::BIGINT"
    return f"""WITH {_EDGES}, {_IDS},
        sized AS (SELECT id, {n} AS n FROM ids),
        numbered AS (SELECT id, unnest(range(1, n + 1)) AS i FROM sized),
        drawn AS (SELECT id, {digest} AS h FROM numbered)
        SELECT id AS account_id, (h % {generate.MAX_IP} + 1)::INTEGER AS ip,
               (h // {generate.MAX_IP}) % {generate.LAST_TS - generate.FIRST_TS + 1} + {generate.FIRST_TS} AS ts FROM drawn"""


def oracle_sql() -> dict[str, str]:
    edges = "SELECT l_partkey AS src, l_orderkey AS dst FROM lineitem"
    degrees = f"WITH {_GRAPH} SELECT id, followers, pursuers FROM degrees"
    web_log = f"WITH {_WEB_LOG} SELECT account_id, ip, ts FROM web_log"
    ranks = "SELECT c_custkey AS account_id, c_acctbal AS page_rank FROM customer"
    ids = f"WITH {_EDGES}, {_IDS} SELECT id FROM ids"
    of_top = f"WITH {_ALL_VISITS} SELECT account_id, ip, ts FROM of_top"
    average = f"""WITH {_VISITS}
        SELECT round(avg(page_rank), 6) AS avg_page_rank FROM of_top JOIN ranks USING (account_id)"""
    centres = ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(DIMENSIONS))
    labels = f"a{ROUNDS}"
    grep = (
        f"SELECT sum((length(text) - length(replace(text, '{NEEDLE}', ''))) // {len(NEEDLE)})::BIGINT AS n "
        "FROM documents"
    )
    extra = {} if llm_queries is None else llm_queries.oracle_sql()
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL is not None:
        extra |= {"pipeline": corpus_pipeline.ORACLE_SQL}
    return extra | {
        "text_scan_edges": edges,
        "text_scan_weblog": web_log,
        "text_scan_rank": ranks,
        "text_scan_points": f"WITH {_GRAPH} SELECT id, followers::DOUBLE AS x, pursuers::DOUBLE AS y FROM degrees",
        "text_scan_centroids": f"""WITH {_GRAPH}
            SELECT id::INTEGER AS cid, followers::DOUBLE AS x, pursuers::DOUBLE AS y FROM degrees""",
        "text_scan_vectors": f"""WITH {_GRAPH}
            SELECT id::DOUBLE AS v0, followers::DOUBLE AS v1, pursuers::DOUBLE AS v2 FROM degrees""",
        "token_ids": ids,
        "line_count": "SELECT sum(len(string_split(text, chr(10))))::BIGINT AS n FROM documents",
        "grep_count": grep,
        "weblog_time_filter": f"WITH {_VISITS} SELECT account_id, ip, ts FROM period",
        "weblog_ip_counts": f"WITH {_ALL_VISITS} SELECT ip, count(*)::BIGINT AS n FROM web_log GROUP BY ip",
        "weblog_top_ip": f"WITH {_ALL_VISITS} SELECT ip, n FROM top",
        "weblog_of_top_ip": of_top,
        "weblog_join_top_ip": of_top,
        "rank_weblog_join": f"""WITH {_ALL_VISITS}
            SELECT account_id, page_rank, ts, ip FROM web_log JOIN ranks USING (account_id)""",
        "join_task": average,
        "join_task_sum_count": f"""WITH {_VISITS}
            SELECT round(sum(page_rank) / count(*), 6) AS avg_page_rank FROM of_top JOIN ranks USING (account_id)""",
        "weblog_generate": _generate_sql(),
        "account_ids": ids,
        "in_degree": f"WITH {_EDGES} SELECT dst AS id, count(*)::BIGINT AS n FROM edges GROUP BY dst",
        "out_degree": f"WITH {_EDGES} SELECT src AS id, count(*)::BIGINT AS n FROM edges GROUP BY src",
        "follower_count": f"WITH {_GRAPH} SELECT id, followers AS n FROM degrees",
        "pursuer_count": f"WITH {_GRAPH} SELECT id, pursuers AS n FROM degrees",
        "follower_pursuer_count": degrees,
        "follower_pursuer_join": degrees,
        "neighbour_id_sum": f"WITH {_EDGES} SELECT src AS id, sum(dst)::BIGINT AS id_sum FROM edges GROUP BY src",
        "weighted_edges": f"WITH {_EDGES} SELECT src, dst, 1.0::DOUBLE AS weight FROM edges",
        "vertex_init": f"WITH {_EDGES}, {_IDS} SELECT id, 1.0::DOUBLE AS rank FROM ids",
        "out_weight_sum": f"WITH {_EDGES} SELECT src, count(*)::DOUBLE AS weight_sum FROM edges GROUP BY src",
        "edge_weights": f"""WITH {_EDGES}, {_OUTS}
            SELECT src, dst, round(1.0::DOUBLE / n, 10) AS weight FROM edges JOIN outs ON outs.id = src""",
        "pagerank_1": _pagerank_sql(1, "1.0::DOUBLE"),
        "pagerank_10": _pagerank_sql(ROUNDS, "1.0::DOUBLE"),
        "pagerank_10_uniform": _pagerank_sql(ROUNDS, "1.0::DOUBLE / (SELECT n FROM total)"),
        "kmeans_assign": _kmeans_sql(0, "SELECT id, cid FROM a0"),
        "kmeans_assign_many": _kmeans_sql(0, "SELECT id, cid FROM a0", MANY),
        "kmeans_update": _kmeans_sql(1, "SELECT cid, round(x, 6) AS x, round(y, 6) AS y, n FROM c1"),
        "kmeans_centroids": _kmeans_sql(
            ROUNDS, f"SELECT cid, round(x, 6) AS x, round(y, 6) AS y FROM c{ROUNDS}"
        ),
        "kmeans_points": _kmeans_sql(ROUNDS, f"SELECT id, x, y, cid FROM a{ROUNDS}"),
        "kmeans_cost": _kmeans_sql(ROUNDS, f"SELECT round(sum(d * d), 4) AS cost FROM a{ROUNDS}"),
        "kmeans_seeded_vectors": _seeded_sql(_EMBEDDED, DIMENSIONS, f"SELECT id AS vec_id, cid::INTEGER AS cid FROM {labels}"),
        "kmeans_seeded_vector_centres": _seeded_sql(
            _EMBEDDED, DIMENSIONS, f"SELECT cid::INTEGER AS cid, {centres} FROM c{ROUNDS}"
        ),
        "kmeans_seeded_vector_cost": _seeded_sql(
            _EMBEDDED, DIMENSIONS, f"SELECT {K}::INTEGER AS k, round(sum(d * d), 4) AS cost FROM {labels}"
        ),
        "kmeans_seeded_accounts": _seeded_sql(_ACCOUNTS, 3, f"SELECT id, cid::INTEGER AS cid FROM {labels}"),
        "kmeans_seeded_account_centres": _seeded_sql(
            _ACCOUNTS,
            3,
            f"""SELECT cid::INTEGER AS cid, round(f0, 6) AS id, round(f1, 6) AS followers, round(f2, 6) AS pursuers
                FROM c{ROUNDS}""",
        ),
        "kmeans_seeded_account_cost": _seeded_sql(
            _ACCOUNTS, 3, f"SELECT {K}::INTEGER AS k, round(sum(d * d), 2) AS cost FROM {labels}"
        ),
        "kmeans_ml_random": _seeded_sql(_EMBEDDED, DIMENSIONS, f"SELECT id AS vec_id, cid::INTEGER AS cluster FROM {labels}"),
        "kmeans_ml_cost": _seeded_sql(
            _EMBEDDED, DIMENSIONS, f"SELECT {K}::INTEGER AS k, round(sum(d * d), 4) AS cost FROM {labels}"
        ),
        "kmeans_ml_degrees": _seeded_sql(_ACCOUNTS, 3, f"SELECT id, cid::INTEGER AS cluster FROM {labels}"),
        "kmeans_ml_misplaced": f"WITH {_EDGES}, {_IDS} SELECT count(*)::BIGINT AS accounts, 0::BIGINT AS misplaced FROM ids",
        "sink_json": web_log,
        "sink_text": degrees,
        "sink_csv": ranks,
        "sink_single_file": f"WITH {_GRAPH} SELECT id, followers, pursuers, 1::BIGINT AS files FROM degrees",
        "job_grep": grep,
        "job_line_count": f"WITH {_WEB_LOG} SELECT count(*)::BIGINT AS n FROM web_log",
        "job_neighbour_sums": f"WITH {_EDGES} SELECT src AS id, sum(dst)::BIGINT AS id_sum FROM edges GROUP BY src",
        "job_degree_files": f"""WITH {_GRAPH}
            SELECT 'both' AS file, id, followers AS first, pursuers AS second FROM degrees
            UNION ALL SELECT 'followers', id, followers, NULL FROM degrees
            UNION ALL SELECT 'pursuers', id, pursuers, NULL FROM degrees""",
        "job_top_visitor_rank": average,
        "job_lloyd_kmeans": _kmeans_sql(
            ROUNDS,
            f"""SELECT 'points' AS file, cid, x, y FROM a{ROUNDS}
                UNION ALL SELECT 'centroids', cid, round(x, 6), round(y, 6) FROM c{ROUNDS}""",
        ),
        "job_page_ranks": _pagerank_sql(ROUNDS, "1.0::DOUBLE"),
        "job_visit_log": _generate_sql(),
    }
