"""The registered queries of the clone engine and, where SQL can express them, their oracles for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions.labels import AUTO_REFACTOR_FLOOR, REVIEW_FIRST_FLOOR, classify, tier_for, type_rank
from .operators import bags, cluster, exact, near
from .operators.components import connected_components
from .plans.compare import compare, findings, numbered
from .operators.normalize.tree import FNV_OFFSET, FNV_PRIME
from .operators.packed import packed_texts, packed_turns
from .plans.report import findings_json, summary
from .plans.session import materialized
from .schema import PRODUCTION
from .sources.tables import ascii_tokens, history_forms, text_counts, text_forms

Query = Callable[[SparkSession, str], DataFrame]
T = 0.85
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    return text_forms(table(spark, sf_dir, "documents"), "doc_id", "text", "documents", F.col(kind) if kind else None)


def docs_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_texts(table(spark, sf_dir, "documents"), "doc_id", "text", F.lit(PRODUCTION))


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return history_forms(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], ["event_type"], "users")


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return history_forms(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", ["l_linenumber", "l_partkey"], ["l_partkey"], "orders")


def suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return history_forms(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", ["l_orderkey", "l_linenumber"], ["l_partkey"], "suppliers")


def conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A form for each conversation; fingerprints are tokens with the role that said them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(ascii_tokens(F.col("text"))).alias("place", "word"))
    rows = rows.withColumn("fp", F.concat_ws(":", "role", F.lower("word")))
    return history_forms(rows, "conv_id", "fp", ["turn", "place"], ["role", "word"], "conversations")


# -- SQL fragments

DOC_BAG = """forms AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS trace, lang FROM documents),
bag AS (SELECT id AS form_id, lower(t) AS fp, count(*)::BIGINT AS cnt FROM (SELECT id, unnest(trace) AS t FROM forms) GROUP BY ALL)"""
EVENT_BAG = """forms AS (SELECT user_id AS id, list(event_type ORDER BY ts, event_id) AS trace FROM events GROUP BY ALL),
bag AS (SELECT user_id AS form_id, event_type AS fp, count(*)::BIGINT AS cnt FROM events GROUP BY ALL)"""
ORDER_BAG = """forms AS (SELECT l_orderkey AS id, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) AS trace FROM lineitem GROUP BY ALL),
bag AS (SELECT l_orderkey AS form_id, l_linestatus AS fp, count(*)::BIGINT AS cnt FROM lineitem GROUP BY ALL)"""
SUPPLIER_BAG = """forms AS (SELECT l_suppkey AS id, list(l_partkey::VARCHAR ORDER BY l_orderkey, l_linenumber) AS trace FROM lineitem GROUP BY ALL),
bag AS (SELECT l_suppkey AS form_id, l_partkey AS fp, count(*)::BIGINT AS cnt FROM lineitem GROUP BY ALL)"""
CONV_BAG = """said AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS word FROM conversations),
forms AS (SELECT DISTINCT conv_id AS id, []::VARCHAR[] AS trace FROM said),
bag AS (SELECT conv_id AS form_id, role || ':' || lower(word) AS fp, count(*)::BIGINT AS cnt FROM said GROUP BY ALL)"""


def keys_sql(kind: str = "'production'") -> str:
    return f"""keyed AS (SELECT form_id, list(fp::VARCHAR || '=' || cnt::VARCHAR ORDER BY fp::VARCHAR) AS bag_key, sum(cnt)::BIGINT AS bag_size FROM bag GROUP BY ALL),
keys AS (SELECT k.*, f.trace, {kind} AS kind FROM keyed k JOIN forms f ON f.id = k.form_id)"""


GROUPS = """traces AS (SELECT bag_key, kind, trace, count(*)::BIGINT AS n FROM keys GROUP BY ALL),
groups AS (SELECT bag_key, kind, sum(n)::BIGINT AS forms, max(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS leftover FROM traces GROUP BY ALL HAVING sum(n) >= 2)"""
REST = """rest AS (SELECT k.form_id, k.kind, k.bag_size FROM keys k WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.bag_key = k.bag_key AND g.kind = k.kind)),
rbag AS (SELECT b.*, r.kind, r.bag_size FROM bag b JOIN rest r USING (form_id))"""


def edges_sql(t: float) -> str:
    """Brute force over all pairs that share a key: no prefixes, no window."""
    return f"""both_ AS (SELECT a.form_id AS left_id, a.bag_size AS ls, b.form_id AS right_id, b.bag_size AS rs, sum(least(a.cnt, b.cnt))::BIGINT AS i
  FROM rbag a JOIN rbag b ON a.fp = b.fp AND a.kind = b.kind AND (a.bag_size < b.bag_size OR (a.bag_size = b.bag_size AND a.form_id < b.form_id)) GROUP BY ALL),
edges AS (SELECT left_id, ls, right_id, rs, i::DOUBLE / (ls + rs - i)::DOUBLE AS score FROM both_ WHERE i::DOUBLE / (ls + rs - i)::DOUBLE >= {t} AND i < ls + rs - i)"""


COMPONENTS = """arcs AS (SELECT left_id AS a, right_id AS b FROM edges UNION ALL SELECT right_id, left_id FROM edges),
reach(form_id, root) AS (SELECT DISTINCT a, a FROM arcs UNION SELECT arcs.b, reach.root FROM reach JOIN arcs ON arcs.a = reach.form_id),
comp AS (SELECT form_id, min(root) AS component FROM reach GROUP BY ALL)"""
STATS = """stats AS (SELECT component, forms, edges, score, edges * 2 = forms * (forms - 1) AS closed FROM
  (SELECT component, count(*)::BIGINT AS forms FROM comp GROUP BY ALL) JOIN
  (SELECT c.component, count(*)::BIGINT AS edges, min(e.score) AS score FROM edges e JOIN comp c ON c.form_id = e.left_id GROUP BY ALL) USING (component))"""
TIER = "CASE WHEN score >= 0.95 THEN 'auto_refactor' WHEN score >= 0.85 THEN 'review_first' ELSE 'advisory' END"


def near_sql(bag: str, t: float, kind: str = "'production'") -> str:
    return f"{bag}, {keys_sql(kind)}, {GROUPS}, {REST}, {edges_sql(t)}"


def greedy_sql(t: float) -> str:
    """Exclusive pairs of open components, taken one by one."""
    return f"""{PREFIX.format(b='rbag', t=t)},
ties AS (SELECT e.left_id, e.right_id, min(p.position) AS tie FROM edges e JOIN prefix p ON p.form_id = e.left_id JOIN prefix q ON q.form_id = e.right_id AND q.fp = p.fp GROUP BY ALL),
opened AS (SELECT e.*, t.tie, row_number() OVER (ORDER BY e.score DESC, e.ls, e.left_id, t.tie, e.rs, e.right_id) AS rn FROM edges e JOIN ties t USING (left_id, right_id) JOIN comp c ON c.form_id = e.left_id JOIN stats s ON s.component = c.component AND NOT s.closed),
walk(rn, used, taken) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL
  SELECT o.rn, CASE WHEN list_contains(w.used, o.left_id) OR list_contains(w.used, o.right_id) THEN w.used ELSE list_concat(w.used, [o.left_id, o.right_id]) END, NOT (list_contains(w.used, o.left_id) OR list_contains(w.used, o.right_id)) FROM walk w JOIN opened o ON o.rn = w.rn + 1)"""


PREFIX = """dfs AS (SELECT fp, count(*)::BIGINT AS df FROM {b} GROUP BY ALL),
ranked AS (SELECT form_id, fp, cnt, df, row_number() OVER w - 1 AS position, coalesce(sum(cnt) OVER (PARTITION BY form_id ORDER BY df, fp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(cnt) OVER (PARTITION BY form_id) AS n
  FROM {b} JOIN dfs USING (fp) WINDOW w AS (PARTITION BY form_id ORDER BY df, fp)),
prefix AS (SELECT form_id, fp, cnt, df, position::BIGINT AS position, n::BIGINT AS bag_size FROM ranked WHERE before_ < n - ceil(n * {t}::DOUBLE - 1e-9) + 1)"""


def findings_sql(bag: str, t: float, lines: str) -> str:
    """Members of all findings; ``lines`` has form_id, path and end_line of each form."""
    return f"""{near_sql(bag, t)}, {COMPONENTS}, {STATS}, {greedy_sql(t)},
members AS (
  SELECT 'type_1' AS clone_type, 1.0::DOUBLE AS score, hash((k.bag_key, k.trace)) AS g, k.form_id FROM keys k JOIN traces t ON t.bag_key = k.bag_key AND t.trace = k.trace AND t.n >= 2
  UNION ALL SELECT 'type_2', 1.0::DOUBLE, hash(k.bag_key), k.form_id FROM keys k JOIN groups g ON g.bag_key = k.bag_key AND g.leftover = 1
  UNION ALL SELECT 'type_3', s.score, hash(c.component), c.form_id FROM comp c JOIN stats s ON s.component = c.component AND s.closed
  UNION ALL SELECT 'type_3', o.score, hash((o.left_id, o.right_id)), unnest([o.left_id, o.right_id]) FROM walk w JOIN opened o USING (rn) WHERE w.taken),
lines AS ({lines}),
flat AS (SELECT m.clone_type, m.score, m.g, m.form_id, l.path, l.end_line FROM members m JOIN lines l USING (form_id))"""


DOC_FINDINGS = findings_sql(DOC_BAG, T, "SELECT doc_id AS form_id, 'documents/' || doc_id AS path, len(string_split(coalesce(text, ''), chr(10)))::INTEGER AS end_line FROM documents")
EVENT_FINDINGS = findings_sql(EVENT_BAG, 0.95, "SELECT user_id AS form_id, 'users/' || user_id AS path, count(*)::INTEGER AS end_line FROM events GROUP BY ALL")
MEMBER_SEQ = "row_number() OVER (PARTITION BY clone_type, g ORDER BY string_split(path, '/'), form_id)"
FINDING_ROWS = f"SELECT clone_type, {TIER} AS tier, score, ({MEMBER_SEQ})::INTEGER AS member_seq, form_id, path, 1::INTEGER AS start_line, end_line, form_id::VARCHAR AS name FROM flat"


# -- bags


@query(f"WITH {DOC_BAG} SELECT form_id, fp, cnt FROM bag")
def bag_build_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir)[1]


@query(f"WITH {DOC_BAG} SELECT form_id, sum(cnt)::BIGINT AS bag_size FROM bag GROUP BY ALL")
def bag_size_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.bag_sizes(docs(spark, sf_dir)[1])


@query(f"WITH {DOC_BAG} SELECT fp, count(*)::BIGINT AS df FROM bag GROUP BY ALL")
def fingerprint_df_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.fingerprint_df(docs(spark, sf_dir)[1])


@query(f"WITH {CONV_BAG} SELECT form_id, fp, cnt FROM bag")
def bag_build_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir)[1]


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'))::INTEGER AS nodes, len(string_split(coalesce(text, ''), chr(10)))::INTEGER AS lines FROM documents WHERE nodes >= 10 AND lines >= 3")
def size_gate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms, _ = docs(spark, sf_dir)
    rows = forms.select(F.col("id").alias("doc_id"), F.col("node_count").alias("nodes"), P.line_count(F.col("start_line"), F.col("end_line")).alias("lines"))
    return rows.where(~P.below_size(F.col("nodes"), F.col("lines"), 10, 3))


@query(f"WITH {DOC_BAG} SELECT form_id, bag_size, (bag_size - ceil(bag_size * 0.85::DOUBLE - 1e-9) + 1)::BIGINT AS mass FROM (SELECT form_id, sum(cnt)::BIGINT AS bag_size FROM bag GROUP BY ALL)")
def prefix_mass_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.bag_sizes(docs(spark, sf_dir)[1]).withColumn("mass", bags.prefix_mass(F.col("bag_size"), T))


@query(f"WITH {DOC_BAG}, {PREFIX.format(b='bag', t=T)} SELECT * FROM prefix")
def prefix_keys_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.prefix_keys(docs(spark, sf_dir)[1], T)


# -- exact


def exact_sizes(forms: DataFrame, bag: DataFrame) -> DataFrame:
    keys = exact.form_keys(forms, bag)
    return keys.groupBy("bag_key", "kind").agg(F.count("*").alias("forms"), F.min("form_id").alias("first_id"), F.max("form_id").alias("last_id")).where("forms >= 2").drop("bag_key")


@query(f"WITH {DOC_BAG}, {keys_sql()} SELECT kind, count(*)::BIGINT AS forms, min(form_id) AS first_id, max(form_id) AS last_id FROM keys GROUP BY bag_key, kind HAVING count(*) >= 2")
def exact_buckets_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sizes(*docs(spark, sf_dir))


@query(f"WITH {DOC_BAG}, {keys_sql('f.lang')} SELECT kind, count(*)::BIGINT AS forms, min(form_id) AS first_id, max(form_id) AS last_id FROM keys GROUP BY bag_key, kind HAVING count(*) >= 2")
def exact_by_kind_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sizes(*docs(spark, sf_dir, "lang"))


def type_groups(forms: DataFrame, bag: DataFrame, clone_type: str) -> DataFrame:
    members = exact.exact_members(exact.form_keys(forms, bag)).where(F.col("clone_type") == clone_type)
    return members.groupBy("finding_key").agg(F.count("*").alias("forms"), F.min("form_id").alias("first_id"), F.max("form_id").alias("last_id")).drop("finding_key")


TYPE1_SQL = "SELECT count(*)::BIGINT AS forms, min(form_id) AS first_id, max(form_id) AS last_id FROM keys GROUP BY bag_key, kind, trace HAVING count(*) >= 2"
TYPE2_SQL = "SELECT count(*)::BIGINT AS forms, min(form_id) AS first_id, max(form_id) AS last_id FROM keys k JOIN groups g ON g.bag_key = k.bag_key AND g.kind = k.kind AND g.leftover = 1 GROUP BY k.bag_key, k.kind"


@query(f"WITH {DOC_BAG}, {keys_sql()} {TYPE1_SQL}")
def type1_groups_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_groups(*docs(spark, sf_dir), "type_1")


@query(f"WITH {DOC_BAG}, {keys_sql()}, {GROUPS} {TYPE2_SQL}")
def type2_groups_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_groups(*docs(spark, sf_dir), "type_2")


@query(f"WITH {ORDER_BAG}, {keys_sql()} {TYPE1_SQL}")
def type1_groups_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_groups(*orders(spark, sf_dir), "type_1")


@query(f"WITH {ORDER_BAG}, {keys_sql()}, {GROUPS} {TYPE2_SQL}")
def type2_groups_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_groups(*orders(spark, sf_dir), "type_2")


ROLE_BAG = """forms AS (SELECT conv_id AS id, list(text ORDER BY turn, text) AS trace FROM conversations GROUP BY ALL),
bag AS (SELECT conv_id AS form_id, role AS fp, count(*)::BIGINT AS cnt FROM conversations WHERE role IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {ROLE_BAG}, {keys_sql()}, {GROUPS} {TYPE2_SQL}")
def type2_groups_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the same turns of each role, whatever was said."""
    return type_groups(*history_forms(table(spark, sf_dir, "conversations").where("role is not null"), "conv_id", "role", ["turn", "text"], ["text"], "conversations"), "type_2")


@query(f"WITH {DOC_BAG}, {keys_sql()}, {GROUPS} SELECT k.form_id FROM keys k JOIN groups g ON g.bag_key = k.bag_key AND g.kind = k.kind")
def claimed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.claimed(exact.form_keys(*docs(spark, sf_dir)))


@query(f"WITH {DOC_BAG}, {keys_sql()}, {GROUPS}, {REST} SELECT form_id, kind, bag_size FROM rest")
def unclaimed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.unclaimed(exact.form_keys(*docs(spark, sf_dir)))


# -- near misses


def rest_of(forms: DataFrame, bag: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    return materialized(exact.unclaimed(materialized(exact.form_keys(forms, bag) if packed is None else packed.drop("bag"))))


def edges_of(forms: DataFrame, bag: DataFrame, t: float, packed: DataFrame | None = None) -> DataFrame:
    return near.near_miss_edges(rest_of(forms, bag, packed), bag, t, materialized, packed)


def shown(edges: DataFrame) -> DataFrame:
    return edges.select("left_id", "right_id", "score")


@query(f"WITH {near_sql(DOC_BAG, T)} SELECT left_id, right_id, score FROM edges")
def near_miss_edges_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(edges_of(*docs(spark, sf_dir), T, docs_packed(spark, sf_dir)))


@query(f"WITH {near_sql(EVENT_BAG, T)} SELECT left_id, right_id, score FROM edges")
def near_miss_edges_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(edges_of(*events(spark, sf_dir), T))


@query(f"WITH {near_sql(SUPPLIER_BAG, 0.1)} SELECT left_id, right_id, score FROM edges")
def near_miss_edges_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(edges_of(*suppliers(spark, sf_dir), 0.1))


@query(f"WITH {near_sql(CONV_BAG, 0.25)} SELECT left_id, right_id, score FROM edges")
def near_miss_edges_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = materialized(packed_turns(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", F.lit(PRODUCTION)))
    return shown(edges_of(*conversations(spark, sf_dir), 0.25, packed))


@query(
    f"WITH {EVENT_BAG}, sized AS (SELECT b.*, sum(cnt) OVER (PARTITION BY form_id) AS n FROM bag b) SELECT a.form_id AS left_id, b.form_id AS right_id, sum(least(a.cnt, b.cnt))::BIGINT::DOUBLE / (any_value(a.n) + any_value(b.n) - sum(least(a.cnt, b.cnt)))::BIGINT::DOUBLE AS score FROM sized a JOIN sized b ON a.fp = b.fp AND (a.n < b.n OR (a.n = b.n AND a.form_id < b.form_id)) GROUP BY ALL"
)
def jaccard_pairs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold 0: all pairs that share a key, also exact ones."""
    _, bag = events(spark, sf_dir)
    return shown(near.all_pairs(materialized(bag), materialized))


# -- components


def components_of(edges: DataFrame) -> DataFrame:
    roots = connected_components(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")), materialized)
    return roots.select(F.col("node").alias("form_id"), F.col("root").alias("component"))


@query(f"WITH RECURSIVE {near_sql(DOC_BAG, T)}, {COMPONENTS} SELECT form_id, component FROM comp")
def components_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(edges_of(*docs(spark, sf_dir), T, docs_packed(spark, sf_dir)))


@query(f"WITH RECURSIVE {near_sql(EVENT_BAG, T)}, {COMPONENTS} SELECT form_id, component FROM comp")
def components_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(edges_of(*events(spark, sf_dir), T))


def stats_of(edges: DataFrame) -> DataFrame:
    return cluster.component_stats(materialized(cluster.with_components(edges, materialized)))


@query(f"WITH RECURSIVE {near_sql(DOC_BAG, T)}, {COMPONENTS}, {STATS} SELECT component, forms, edges, score FROM stats WHERE closed")
def closed_components_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(edges_of(*docs(spark, sf_dir), T, docs_packed(spark, sf_dir))).where("closed").drop("closed")


@query(f"WITH RECURSIVE {near_sql(EVENT_BAG, T)}, {COMPONENTS}, {STATS} SELECT component, forms, edges, score FROM stats WHERE NOT closed")
def open_components_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(edges_of(*events(spark, sf_dir), T)).where("not closed").drop("closed")


@query(f"WITH RECURSIVE {near_sql(EVENT_BAG, T)}, {COMPONENTS}, {STATS}, {greedy_sql(T)} SELECT o.left_id, o.right_id, o.score FROM walk w JOIN opened o USING (rn) WHERE w.taken")
def greedy_pairs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms, bag = events(spark, sf_dir)
    rest = rest_of(forms, bag)
    parts = materialized(cluster.with_components(near.near_miss_edges(rest, bag, T, materialized), materialized))
    return cluster.open_pairs(parts, materialized(cluster.component_stats(parts)), lambda e: near.with_ties(e, rest, bag, materialized), materialized)


# -- findings


def members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return compare(*docs(spark, sf_dir), T, docs_packed(spark, sf_dir), lambda ids: text_counts(rows, "doc_id", "text", ids), lambda ids: text_forms(rows.join(ids.withColumnRenamed("form_id", "doc_id"), "doc_id", "left_semi"), "doc_id", "text", "documents")[1])


@query(f"WITH RECURSIVE {DOC_FINDINGS} {FINDING_ROWS}")
def findings_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members_of(spark, sf_dir).drop("finding_key")


@query(
    f"WITH RECURSIVE {DOC_FINDINGS}, heads AS (SELECT clone_type, score, g, count(*)::BIGINT AS members, min(path) AS first_path FROM flat GROUP BY ALL) SELECT (row_number() OVER (ORDER BY score DESC, first_path, CASE clone_type WHEN 'type_1' THEN 1 WHEN 'type_2' THEN 2 ELSE 3 END))::INTEGER AS place, clone_type, score, members, first_path FROM heads"
)
def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of findings in a report."""
    found = findings(members_of(spark, sf_dir)).select("clone_type", "score", F.size("members").cast("bigint").alias("members"), F.get("members", F.lit(0))["path"].alias("first_path"))
    return numbered(found, [F.desc("score"), F.asc("first_path"), F.asc(type_rank(F.col("clone_type")))], "place", materialized)


@query(
    f"WITH RECURSIVE {DOC_FINDINGS}, heads AS (SELECT DISTINCT clone_type, score, g, {TIER} AS tier FROM flat) SELECT 0::BIGINT AS files_scanned, 0::BIGINT AS forms_compared, 0::BIGINT AS parse_warnings, "
    + ", ".join(f"count(*) FILTER (tier = '{t}')::BIGINT AS {t}" for t in ("auto_refactor", "review_first", "advisory"))
    + ", "
    + ", ".join(f"count(*) FILTER (clone_type = '{t}')::BIGINT AS {t}" for t in ("type_1", "type_2", "type_3"))
    + " FROM heads"
)
def summary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(members_of(spark, sf_dir).select("finding_key", "clone_type", "tier").distinct())


@query(f"WITH {near_sql(EVENT_BAG, 0.5)} SELECT {TIER} AS tier, 'type_3' AS clone_type, count(*)::BIGINT AS edges FROM edges GROUP BY ALL")
def tier_counts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms, bag = events(spark, sf_dir)
    found = near.near_miss_counts(rest_of(forms, bag), bag, 0.5, [REVIEW_FIRST_FLOOR, AUTO_REFACTOR_FLOOR], materialized)
    return found.groupBy(tier_for(F.col("score")).alias("tier"), classify(F.col("score"), F.lit(False)).alias("clone_type")).agg(F.sum("pairs").alias("edges"))


@query(f"WITH RECURSIVE {EVENT_FINDINGS} {FINDING_ROWS}")
def findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(*events(spark, sf_dir), 0.95).drop("finding_key")


@query(
    f"""WITH RECURSIVE {DOC_FINDINGS}, seq AS (SELECT *, {MEMBER_SEQ} AS member_seq FROM flat)
SELECT '{{"clone_type":"' || clone_type || '","tier":"' || {TIER} || '","score":' || score::VARCHAR || ',"members":[' || string_agg('{{"path":"' || path || '","start_line":1,"end_line":' || end_line || ',"name":"' || form_id || '"}}', ',' ORDER BY member_seq) || ']}}' AS finding FROM seq GROUP BY clone_type, score, g"""
)
def report_json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_json(findings(members_of(spark, sf_dir)))


# -- predicates and paths


@query(
    "SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: regexp_matches(x, '^\\s*(//[/!]?|#)\\s*Released([^A-Za-z0-9_-]|$)') OR regexp_matches(x, '^\\s*/\\*\\*?\\s*Released([^A-Za-z0-9_-].*)?\\*/\\s*$')))::INTEGER AS directives, len(list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n')[1:40], lambda x: regexp_matches(x, '^\\s*(//[/!]?|#)\\s*Released-file([^A-Za-z0-9_-]|$)'))) > 0 AS ignored FROM documents"
)
def suppress_lines_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(P.lines_of(text), lambda x: P.directive_matches(x, "Released"))).alias("directives"), P.file_is_ignored(text, "Released").alias("ignored"))


PAGE_PATH = "regexp_replace(regexp_replace(coalesce(url, ''), '^[a-z]+://', ''), '[?#].*$', '')"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query(
    f"WITH p AS (SELECT page_id, {PAGE_PATH} AS path FROM pages), q AS (SELECT *, string_split(path, '/') AS parts FROM p) SELECT page_id, CASE WHEN suffix(parts[-1], '_test.go') THEN 'test' ELSE 'production' END AS go, CASE WHEN contains(parts[-1], '.test.') OR contains(parts[-1], '.spec.') OR list_contains(parts, '__tests__') THEN 'test' ELSE 'production' END AS ts, CASE WHEN regexp_matches(parts[-1], '^test_.*\\.py$|_test\\.py$') OR list_contains(parts, 'tests') OR list_contains(parts, 'test') THEN 'test' ELSE 'production' END AS py FROM q"
)
def path_kind_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).select("page_id", *(P.kind_of(F.col("path"), lang).alias(lang) for lang in ("go", "ts", "py")))


@query(f"WITH p AS (SELECT page_id, {PAGE_PATH} AS path FROM pages) SELECT page_id, path <> '' AND list_has_any(string_split(path, '/'), ['en', 'target']) AS excluded FROM p")
def path_exclude_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).select("page_id", P.is_excluded(F.col("path"), ["en", "target"]).alias("excluded"))


@query(f"WITH p AS (SELECT page_id, string_split({PAGE_PATH}, '/')[1] AS host FROM pages) SELECT page_id, lower(regexp_extract(host, '^.+\\.([^.]*)$', 1)) IN ('com', 'org') AS wanted FROM p")
def path_extension_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_paths(spark, sf_dir).withColumn("host", F.get(F.split("path", "/"), F.lit(0)))
    return rows.select("page_id", P.has_extension(F.col("host"), ["COM", "org"]).alias("wanted"))


@query(
    "WITH p AS (SELECT page_id, coalesce(url, '') AS path FROM pages) SELECT page_id, CASE WHEN starts_with(path, 'https:/') THEN path[8:] WHEN starts_with(path, 'http:/') THEN path[7:] ELSE path END AS relative FROM p"
)
def relativize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as paths, below the roots https: and http:."""
    return table(spark, sf_dir, "pages").select("page_id", P.relativize(F.coalesce("url", F.lit("")), ["https:", "http:"]).alias("relative"))


@query(
    f"WITH {DOC_BAG}, t AS (SELECT id, unnest(trace) AS name, generate_subscripts(trace, 1) AS pos FROM forms), f AS (SELECT id, name, min(pos) AS first_pos, count(*)::BIGINT AS uses FROM t GROUP BY ALL) SELECT id AS form_id, name, uses, (dense_rank() OVER (PARTITION BY id ORDER BY first_pos) - 1)::INTEGER AS placeholder FROM f"
)
def placeholder_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers numbered by first sight, within each form."""
    from pyspark.sql import Window

    forms, _ = docs(spark, sf_dir)
    names = forms.select(F.col("id").alias("form_id"), F.posexplode("ident_trace").alias("pos", "name")).groupBy("form_id", "name").agg(F.min("pos").alias("first_pos"), F.count("*").alias("uses"))
    return names.select("form_id", "name", "uses", (F.dense_rank().over(Window.partitionBy("form_id").orderBy("first_pos")) - 1).alias("placeholder"))


# -- trees


def page_forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .operators.normalize import forms_and_bag, normalize_files

    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_seq"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("source"))
    return forms_and_bag(materialized(normalize_files(files, "html", 1, 1)))


@query()
def html_tree_bags_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_forms(spark, sf_dir)[1]


@query()
def findings_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(*page_forms(spark, sf_dir), 0.95).drop("finding_key")


@query(
    f"WITH {DOC_BAG}, t AS (SELECT DISTINCT fp, list_concat(list_transform(string_split(fp, ''), lambda c: ascii(c)::HUGEINT), [0::HUGEINT]) AS bytes FROM bag), d AS (SELECT fp, list_reduce(list_concat([{FNV_OFFSET}::HUGEINT], bytes), lambda h, b: (xor(h, b) * {FNV_PRIME}) % 18446744073709551616) AS h FROM t) SELECT fp, CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::BIGINT AS digest FROM d"
)
def fnv_digests_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FNV digest of every distinct lower-case token of documents, as a leaf of a tree."""
    from collections.abc import Iterator

    import pyarrow as pa

    from .operators.normalize.tree import hash_subtree, signed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(hash_subtree(x, [])) for x in b.column(0).to_pylist()], pa.int64())], names=["fp", "digest"])

    return bags.fingerprint_df(docs(spark, sf_dir)[1]).select("fp").mapInArrow(run, "fp string, digest bigint")


def queries() -> dict[str, Query]:
    from . import source_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import source_queries  # noqa: F401

    return dict(SQL)
