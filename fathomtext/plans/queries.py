"""The library's operators over the synthetic tables, each with the SQL it must agree with.

The tables hold no report Markdown, so each query applies an operator to columns of the same shape:
anchor texts of pages are mentions, order lines are baskets, documents are report texts, order lines
by supplier and year are statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance as M
from ..functions import text as X
from ..operators import discover, mentions, network, statements, themes
from ..operators.scope import Scope, in_sectors, parse_batches, without

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- mentions and graph ------------------------------------------------------------------------
ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'
LISTED = ["the", "and", "of", "The", "And", "Der", "die", "de", "la"]
ANCHORS_SQL = """a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS name FROM pages)"""
LISTED_SQL = ", ".join(f"'{x}'" for x in LISTED)
CATEGORY_SQL = f"CASE WHEN name IN ({LISTED_SQL}) THEN 'technology' WHEN strlen(name) > length(name) THEN 'taiwan_company' ELSE 'international_company' END"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mentions(read(spark, sf_dir, "pages"), F.regexp_extract_all(F.col("html"), F.lit(ANCHOR), F.lit(2)), "page_id")


def script_category(name: Column) -> Column:
    return F.when(name.isin(*LISTED), "technology").when(F.octet_length(name) > F.length(name), "taiwan_company").otherwise("international_company")


def anchor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.index(mentions.bag_counts(anchors(spark, sf_dir)), script_category(F.col("name")), F.col("name").isin(*LISTED))


INDEX_SQL = f"WITH {ANCHORS_SQL}, c AS (SELECT name, {CATEGORY_SQL} AS category, count(*) AS cnt FROM a GROUP BY name), i AS (SELECT * FROM c WHERE name IN ({LISTED_SQL}) OR cnt >= 2)"


@query(f"{INDEX_SQL} SELECT name, category, cnt FROM i")
def mention_index(spark, sf_dir):
    return anchor_index(spark, sf_dir)


@query(f"""{INDEX_SQL} SELECT name, category, cnt, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY cnt DESC, name) AS rank,
count(*) OVER (PARTITION BY category) AS total FROM i) WHERE rank <= 20""")
def mention_topk_per_category(spark, sf_dir):
    return mentions.top_of_each_category(anchor_index(spark, sf_dir), 20)


@query(f"{INDEX_SQL} SELECT category, count(DISTINCT name) AS names, sum(cnt)::BIGINT AS mentions FROM i GROUP BY category")
def vocabulary_totals(spark, sf_dir):
    return anchor_index(spark, sf_dir).groupBy("category").agg(F.count_distinct("name").alias("names"), F.sum("cnt").alias("mentions"))


@query(f"WITH {ANCHORS_SQL} SELECT name, count(DISTINCT page_id) AS df FROM a GROUP BY name HAVING count(DISTINCT page_id) >= 2")
def doc_frequency(spark, sf_dir):
    return mentions.document_frequency(anchors(spark, sf_dir), "page_id", 2)


EDGES_SQL = f"""{ANCHORS_SQL}, d AS (SELECT DISTINCT page_id, name FROM a), f AS (SELECT name, count(*) AS df FROM d GROUP BY name),
k AS (SELECT d.* FROM d JOIN f USING (name) WHERE df >= 2),
e AS (SELECT x.name AS source, y.name AS target, count(*) AS weight FROM k x JOIN k y ON x.page_id = y.page_id AND x.name < y.name GROUP BY ALL HAVING count(*) >= 5)"""


@query(f"WITH {EDGES_SQL} SELECT source, target, weight FROM e")
def network_edges(spark, sf_dir):
    return network.edges(anchors(spark, sf_dir), "page_id")


BASKET_SQL = "b AS (SELECT DISTINCT l_orderkey AS k, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return lines.join(parts, "l_partkey").select("k", "name")


@query(f"WITH {BASKET_SQL} SELECT x.name AS source, y.name AS target, count(*) AS weight FROM b x JOIN b y ON x.k = y.k AND x.name < y.name GROUP BY ALL HAVING count(*) >= 5")
def network_edges_basket(spark, sf_dir):
    return network.edges(baskets(spark, sf_dir), "k")


TOP_SQL = f"""WITH {BASKET_SQL}, f AS (SELECT name, count(*) AS df FROM b GROUP BY name ORDER BY df DESC, name LIMIT 20), k AS (SELECT b.* FROM b JOIN f USING (name)),
e AS (SELECT x.name AS source, y.name AS target, count(*) AS weight FROM k x JOIN k y ON x.k = y.k AND x.name < y.name GROUP BY ALL HAVING count(*) >= 5)"""


@query(f"{TOP_SQL} SELECT source, target, weight FROM e")
def network_topn(spark, sf_dir):
    return network.edges(baskets(spark, sf_dir), "k", top=20)


# --- themes ------------------------------------------------------------------------------------
ROLE_WORDS = {" of ": "upstream", " to ": "downstream", " in ": "midstream"}
ENTRIES_SQL = """t AS (SELECT doc_id, source, right(left(text, position(' and ' IN text) - 1), 100) AS w FROM documents WHERE contains(text, ' and ')),
r AS (SELECT doc_id, source, CASE WHEN contains(w, ' of ') THEN 'upstream' WHEN contains(w, ' to ') THEN 'downstream' WHEN contains(w, ' in ') THEN 'midstream' ELSE 'related' END AS role FROM t)"""


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where(F.contains("text", F.lit(" and ")))
    return docs.select("doc_id", "source", X.positional_role(F.col("text"), " and ", ROLE_WORDS).alias("role"))


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, source, role FROM r")
def theme_entries(spark, sf_dir):
    return doc_entries(spark, sf_dir)


@query(f"WITH {ENTRIES_SQL} SELECT role, source, count(*) AS cnt FROM r GROUP BY role, source")
def theme_role_counts(spark, sf_dir):
    return themes.role_counts(doc_entries(spark, sf_dir), "source")


RELATED = {"the": ["and", "of", "nowhere"], "and": ["the"], "der": ["die", "und"], "de": ["la", "que"]}
RELATED_SQL = ", ".join(f"('{t}', '{r}')" for t, rs in RELATED.items() for r in rs)


@query(f"""WITH d(tag, related) AS (VALUES {RELATED_SQL}) SELECT tag, related, cnt FROM (
SELECT tag, related, (SELECT count(*) FROM documents WHERE contains(text, ' ' || d.related || ' ')) AS cnt FROM d) WHERE cnt > 0""")
def theme_related(spark, sf_dir):
    tags = sorted({r for rs in RELATED.values() for r in rs})
    docs = read(spark, sf_dir, "documents")
    found = docs.select(F.explode(F.filter(F.array(*(F.when(F.contains("text", F.lit(f" {t} ")), t) for t in tags)), lambda x: x.isNotNull())).alias("tag"))
    pairs = spark.createDataFrame(list(RELATED.items()), "tag string, related array<string>")
    return themes.related(pairs, found.groupBy("tag").agg(F.count(F.lit(1)).alias("cnt")))


# --- discovery ---------------------------------------------------------------------------------
COUNT_SQL = lambda s: f"((length(html) - length(replace(html, '{s}', ''))) / {len(s)})::BIGINT"
HITS_SQL = f"""h AS (SELECT page_id, url, html, {COUNT_SQL('>the</a>')} AS linked, {COUNT_SQL('the')} - {COUNT_SQL('>the')} - {COUNT_SQL('the</a>')} + {COUNT_SQL('>the</a>')} AS bare FROM pages),
g AS (SELECT *, CASE WHEN contains(split_part(html, '</nav>', 1), 'the') THEN 'core_business' WHEN contains(html, 'the') THEN 'mentioned' END AS role FROM h WHERE linked + bare > 0)"""


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    role = F.when(F.contains(F.substring_index(html, "</nav>", 1), F.lit("the")), "core_business").otherwise("mentioned")
    rows = read(spark, sf_dir, "pages").select("page_id", X.occurrences(html, "(?<=>)the(?=</a>)").alias("linked"), X.occurrences(html, "(?<!>)the(?!</a>)").alias("bare"), role.alias("role"))
    return rows.where("linked + bare > 0")


@query(f"WITH {HITS_SQL} SELECT page_id, linked, bare, role FROM g")
def discover_hits(spark, sf_dir):
    return page_hits(spark, sf_dir)


@query(f"""WITH {HITS_SQL} SELECT role, count(*) AS docs, count(*) FILTER (WHERE linked > 0) AS linked_docs,
count(*) FILTER (WHERE bare > 0 AND linked = 0) AS unlinked_docs, sum(bare)::BIGINT AS bare FROM g GROUP BY role""")
def discover_role_summary(spark, sf_dir):
    return discover.role_summary(page_hits(spark, sf_dir))


@query(r"""WITH RECURSIVE p AS (SELECT page_id, html, 1 AS ord, position('WORD' IN html) AS k FROM (SELECT page_id, replace(html, 'the', 'WORD') AS html FROM pages) WHERE contains(html, 'WORD')
UNION ALL SELECT page_id, html, ord + 1, k + 3 + position('WORD' IN substr(html, k + 4)) FROM p WHERE ord < 3 AND contains(substr(html, k + 4), 'WORD'))
SELECT page_id, ord::BIGINT AS ord, '...' || regexp_replace(replace(substr(html, greatest(k - 30, 1), least(k - 1, 30)) || substr(html, k, 34), chr(10), ' '), '^\s+|\s+$', '', 'g') || '...' AS snippet FROM p""")
def discover_contexts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("the"), F.lit("WORD")).alias("html"))
    found = pages.select("page_id", F.posexplode(X.snippets(F.col("html"), "WORD", "WORD")).alias("ord", "snippet"))
    return found.select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), "snippet")


@query("""SELECT source, count(*) AS docs FROM documents WHERE source IN ('src0', 'src3', 'src7') AND contains(text, ' the ') GROUP BY source""")
def discover_sector_filter(spark, sf_dir):
    docs = in_sectors(read(spark, sf_dir, "documents"), ["src0", "src3", "src7"], "source")
    return docs.where(F.contains("text", F.lit(" the "))).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


# --- audit -------------------------------------------------------------------------------------
AUDIT_SQL = """i AS (SELECT doc_id, source, CASE WHEN length(text) < 200 THEN ['Content too short'] ELSE
 list_concat(CASE WHEN contains(text, '###') THEN ['Placeholder found: ###'] ELSE [] END, CASE WHEN contains(text, '@') THEN ['Placeholder found: @'] ELSE [] END,
 CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) < 3 THEN ['Text too thin'] ELSE [] END) END AS issues FROM documents),
s AS (SELECT doc_id, source, issues, CASE WHEN len(issues) = 0 THEN 'CLEAN' WHEN issues[1] LIKE 'Content%' OR issues[1] LIKE 'Placeholder%' THEN 'NEEDS ENRICHMENT' ELSE 'NEEDS QUALITY FIX' END AS status FROM i)"""


def doc_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.audit import none, status, when_list

    text = F.col("text")
    thin = F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")) < 3
    rest = F.concat(*(when_list(F.contains(text, F.lit(p)), F.lit(f"Placeholder found: {p}")) for p in ("###", "@")), when_list(thin, F.lit("Text too thin")), none())
    found = F.when(F.length(text) < 200, F.array(F.lit("Content too short"))).otherwise(rest)
    return read(spark, sf_dir, "documents").select("doc_id", "source", found.alias("issues")).withColumn("status", status(F.col("issues")))


@query(f"WITH {AUDIT_SQL} SELECT doc_id, unnest(issues) AS issue, generate_subscripts(issues, 1)::BIGINT AS ord FROM i")
def audit_issues(spark, sf_dir):
    return doc_issues(spark, sf_dir).select("doc_id", F.posexplode("issues").alias("ord", "issue")).select("doc_id", (F.col("ord") + 1).cast("long").alias("ord"), "issue")


@query(f"WITH {AUDIT_SQL} SELECT doc_id, status FROM s")
def audit_status(spark, sf_dir):
    return doc_issues(spark, sf_dir).select("doc_id", "status")


# --- names -------------------------------------------------------------------------------------
ALIASES = {"The": "the", "Der": "der", "De": "de", "And": "and"}
ALIASES_SQL = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES.items())


@query(f"WITH {ANCHORS_SQL} SELECT CASE name {ALIASES_SQL} ELSE name END AS name, count(*) AS cnt FROM a GROUP BY 1")
def alias_normalize(spark, sf_dir):
    return mentions.bag_counts(anchors(spark, sf_dir).select(X.canonical(F.col("name"), ALIASES).alias("name")))


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN '[[' || n_name || ']]' WHEN 1 THEN '[[' || n_name || ']] x' ELSE '[[' || n_name || ']] ([[' || n_name || 'x]])' END AS text FROM nation""")
def collapse_duplicates(spark, sf_dir):
    n = F.concat(F.lit("[["), F.col("n_name"), F.lit("]]"))
    kind = F.col("n_nationkey") % 3
    text = F.when(kind == 0, F.concat(n, F.lit(" ("), n, F.lit(")"))).when(kind == 1, F.concat(n, F.lit("（"), n, F.lit("） x"))).otherwise(F.concat(n, F.lit(" ([["), F.col("n_name"), F.lit("x]])")))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), X.collapse_repeats(text).alias("text"))


# --- statements --------------------------------------------------------------------------------
STATEMENT_SQL = """q AS (SELECT l_suppkey, {period} AS period, sum(l_extendedprice::DECIMAL(18, 2)) AS revenue, sum(l_extendedprice::DECIMAL(18, 2) * (1 - l_discount::DECIMAL(4, 2))) AS profit FROM lineitem GROUP BY ALL)"""
YEAR, QUARTER = "year(l_shipdate)::BIGINT", "(year(l_shipdate) * 10 + quarter(l_shipdate))::BIGINT"


def supplier_periods(spark: SparkSession, sf_dir: str, quarterly: bool = False) -> DataFrame:
    """l_suppkey, period, revenue, profit: the items of a statement from order lines."""
    d = F.col("l_shipdate")
    period = (F.year(d) * 10 + F.quarter(d)) if quarterly else F.year(d)
    cents = lambda x: F.sum(x.cast("decimal(18,2)"))
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey", period.cast("long").alias("period")).agg(cents(F.col("l_extendedprice")).alias("revenue"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("profit"))


def metric_rows(rows: DataFrame) -> DataFrame:
    revenue, profit = F.col("revenue").cast("double"), F.col("profit").cast("double")
    return rows.select("l_suppkey", "period", M.millions(revenue).alias("revenue_m"), M.millions(profit).alias("profit_m"), M.margin(profit, revenue).alias("margin_pct"))


METRIC_SQL = "l_suppkey, period, revenue::DOUBLE / 1e6 AS revenue_m, profit::DOUBLE / 1e6 AS profit_m, profit::DOUBLE / nullif(revenue::DOUBLE, 0) * 100 AS margin_pct"


@query(f"WITH {STATEMENT_SQL.format(period=YEAR)} SELECT {METRIC_SQL} FROM q")
def stmt_metrics(spark, sf_dir):
    return metric_rows(supplier_periods(spark, sf_dir))


def newest(rows: DataFrame, n: int) -> DataFrame:
    return statements.latest(rows.withColumn("kind", F.lit("A")), {"A": n}, "l_suppkey", "kind", "period").drop("kind")


@query(f"WITH {STATEMENT_SQL.format(period=YEAR)} SELECT {METRIC_SQL} FROM q QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY period DESC) <= 3")
def stmt_latest_annual(spark, sf_dir):
    return metric_rows(newest(supplier_periods(spark, sf_dir), 3))


@query(f"WITH {STATEMENT_SQL.format(period=QUARTER)} SELECT {METRIC_SQL} FROM q QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY period DESC) <= 4")
def stmt_latest_quarterly(spark, sf_dir):
    return metric_rows(newest(supplier_periods(spark, sf_dir, True), 4))


@query(f"""WITH {STATEMENT_SQL.format(period=YEAR)} SELECT l_suppkey, period, 'revenue' AS metric, revenue::DOUBLE AS value FROM q UNION ALL SELECT l_suppkey, period, 'profit', profit::DOUBLE FROM q""")
def stmt_unpivot(spark, sf_dir):
    rows = supplier_periods(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("revenue", "profit")})
    return rows.unpivot(["l_suppkey", "period"], ["revenue", "profit"], "metric", "value")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS cnt FROM events GROUP BY 1")
def epoch_dates(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select(F.date_format(M.epoch_date(seconds), "yyyy-MM-dd").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def info_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'labels' ELSE 'derived' END AS src, coalesce(l.quality, (d.n_chars >= 200)::INT)::BIGINT AS value FROM documents d LEFT JOIN labels l USING (doc_id)""")
def source_fallback(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("source"), F.col("quality").cast("long").alias("value"))
    derived = read(spark, sf_dir, "documents").select("doc_id", F.lit("derived").alias("source"), (F.col("n_chars") >= 200).cast("long").alias("value"))
    best = statements.preferred_source(labels.unionByName(derived), "doc_id", ["labels", "derived"], F.col("value").isNotNull())
    return best.select("doc_id", F.col("source").alias("src"), "value")


# --- scope and upsert --------------------------------------------------------------------------
@query("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia'")
def scope_filter(spark, sf_dir):
    scope = Scope.parse(["--sector", "aSiA"])
    region = read(spark, sf_dir, "region").where(scope.predicate(sector="r_name"))
    nation = read(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")


@query("SELECT n_nationkey::INT AS batch, n_nationkey % 2 = 0 AS done, t.ord, CASE t.ord WHEN 0 THEN (1000 + n_nationkey)::VARCHAR ELSE (2000 + n_nationkey)::VARCHAR END AS ticker FROM nation, (VALUES (0::BIGINT), (1::BIGINT)) t(ord)")
def batch_parse(spark, sf_dir):
    k = F.col("n_nationkey")
    line = F.concat(F.lit("- ["), F.when(k % 2 == 0, "x").otherwise(" "), F.lit("] **Batch "), k.cast("string"), F.lit("** ("), F.col("n_name"), F.lit("): "), (1000 + k).cast("string"), F.lit(", "), (2000 + k).cast("string"), F.lit("."))
    parsed = parse_batches(read(spark, sf_dir, "nation").select(line.alias("value")))
    return parsed.select("batch", "done", F.posexplode("tickers").alias("ord", "ticker")).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)")
def exclusion_anti(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderdate >= '1997-01-01' and o_orderdate < '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return without(read(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


from . import report_queries, stored_queries  # noqa: E402, F401  register their queries here
