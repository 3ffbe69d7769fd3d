"""Four outcomes of citations by features of the cited page, for every engine: early place, support, being cited again (page and site)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelab import lineage
from citelab.functions import lists, numbers, urls
from citelab.operators import metrics as M
from citelab.operators import linkage, regression, relational, suffixes
from citelab.plans.core import Star
from citelab.sources.driver_tables import keys as driver_keys
from citelab.sources.driver_tables import table, with_sql

FEATURES = ["page_chars", "secure"]
CONTROLS = ["log_n_cited", "intent_b", "intent_c"]
FIT = "outcome string, engine string, feature string, beta double, se double, z double, p double, n long, groups long"


def frames(spark, sf_dir):
    """Events of pages with a text, and (page or site, engine, query) with the share of the query's repeats that cite it again."""
    s = Star(spark, sf_dir)
    e = M.citation_events(s.keys, s.sents, s.cits, s.scores).select("doc_id", "page_id", "engine", "query_id", "run_index", "supported_share", F.col("is_early3").alias("early3"), F.log1p(F.col("n_cited_in_response").cast("double")).alias("log_n_cited"))
    # the test hosts stand below three suffixes of their own
    known = suffixes.rules(spark, [*lists.SUFFIX_RULES, "example.com", "example.net", "example.org"])
    page = table(spark, sf_dir, "pages").where("trim(html) <> ''").select("page_id", urls.domain_of(F.col("url")).alias("host"), F.log1p(F.length("html").cast("double")).alias("page_chars"), F.startswith("url", F.lit("https:")).cast("double").alias("secure"))
    page = suffixes.with_suffixes(page, "host", known).select("page_id", "page_chars", "secure", F.coalesce("registrable_domain", "host").alias("site"))
    turn = F.ascii(F.substring("query_id", -1, 1)) % 3
    e = e.join(page, "page_id").withColumns({"intent_b": (turn == 1).cast("double"), "intent_c": (turn == 2).cast("double")})
    e = lineage.cut(e.where("engine is not null and query_id is not null and site is not null"))
    runs = s.keys.groupBy("engine", "query_id").agg(F.count("*").alias("k"))
    mean = [F.avg(c).alias(c) for c in (*FEATURES, *CONTROLS)]

    def again(*unit):
        per = e.groupBy("engine", "query_id", *unit).agg(F.count_distinct("run_index").alias("cited"), *mean, *([F.min("site").alias("site")] if "site" not in unit else []))
        return per.join(runs, ["engine", "query_id"]).withColumn("sticky", F.col("cited") / F.col("k"))

    return e, again("page_id"), again("site").withColumnRenamed("sticky", "sticky_domain")


def citation_models(spark, sf_dir):
    """Errors clustered by site; q values step up over the features of a model, without its controls. An outcome that doesn't vary has
    coefficients of 0 and no errors."""
    e, page, site = frames(spark, sf_dir)
    out = []
    for frame, model in ((e, regression.Model("early3", "logit")), (e.where("supported_share is not null").withColumnRenamed("supported_share", "support"), regression.Model("support", "ols")), (page, regression.Model("sticky", "ols")), (site, regression.Model("sticky_domain", "ols"))):
        rows = lineage.cut(regression.centred(frame, "log_n_cited", "engine"))
        for (engine, outcome), fit in sorted(regression.fit_groups(rows, "engine", [*FEATURES, *CONTROLS], [model], "site").items()):
            out += [(outcome, engine, r[0], r[1], r[2] if r[2] < float("inf") else None, *r[3:]) for r in fit.rows() if r[0] in FEATURES]
    q = relational.benjamini_hochberg(spark.createDataFrame(out, FIT), "p", ["outcome", "engine"])
    return q.select("outcome", "engine", "feature", *[numbers.round_signed(c, 5).alias(c) for c in ("beta", "se", "z", "p", "q")], "n", "groups")


def source_linkage(spark, sf_dir):
    """Sources by how alike the lengths of their answers are over engines and repeats: average linkage of 1 - correlation."""
    k = driver_keys(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    names, distances = linkage.correlation_distances(k.withColumn("cell", F.concat_ws("|", "engine", "run_index")), "query_id", "cell", "n_chars")
    merges = linkage.linkage(distances)
    return spark.createDataFrame([(i, a, b, round(h, 6), n) for i, (a, b, h, n) in enumerate(merges)], "step long, first long, second long, height double, size long")


# --- the same in SQL: normal equations, their inverse by elimination, Newton's steps by recursion ------------------------

_K = 1 + len(FEATURES) + len(CONTROLS)


def _inverse(source: str) -> str:
    """source with `inv`, the inverse of its k x k column `gram` (a list of lists), by Gauss and Jordan's elimination."""
    ident = "[" + ", ".join(f"list_concat(gram[{i}], [{', '.join('1e0' if i == j else '0e0' for j in range(1, _K + 1))}])" for i in range(1, _K + 1)) + "]"
    sql = f"SELECT *, {ident} AS m0 FROM ({source})"
    for c in range(1, _K + 1):
        m = f"m{c - 1}"
        sql = f"SELECT * EXCLUDE ({m}), list_transform({m}, lambda r, i: CASE WHEN i = {c} THEN list_transform(r, lambda x: x / {m}[{c}][{c}]) ELSE list_transform(r, lambda x, j: x - r[{c}] * {m}[{c}][j] / {m}[{c}][{c}]) END) AS m{c} FROM ({sql})"
    return f"SELECT * EXCLUDE (m{_K}), list_transform(m{_K}, lambda r: r[{_K + 1}:{2 * _K}]) AS inv FROM ({sql})"


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(1, _K + 1)) + ")"


def _times(m: str, v: str) -> str:
    return "[" + ", ".join(_dot(f"{m}[{i}]", v) for i in range(1, _K + 1)) + "]"


def _sums(cell) -> str:
    return "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(1, _K + 1)) + "]" for i in range(1, _K + 1)) + "]"


def _model_sql(name: str, source: str, logit: bool) -> str:
    """CTEs that end in {name}: (outcome, engine, i, beta, se, n, groups) of a frame (engine, site, y, x)."""
    eta = _dot("x", "beta")
    p = f"(1 / (1 + exp(-greatest(-30e0, least(30e0, {eta})))))" if logit else eta
    w = f"({p} * (1 - {p}))" if logit else "1e0"
    ridge = lambda i, j: " + 1e-8" if logit and i == j else ""
    gram = _sums(lambda i, j: f"sum(x[{i}] * x[{j}] * w){ridge(i, j)}")
    score = "[" + ", ".join(f"sum(x[{i}] * (y - p))" for i in range(1, _K + 1)) + "]"
    zero = "[" + ", ".join(["0e0"] * _K) + "]"
    moved = "[" + ", ".join(f"beta[{i}] + {_dot(f'inv[{i}]', 'score')}" for i in range(1, _K + 1)) + "]"
    products = lambda r: f"SELECT engine, it, any_value(beta) AS beta, {gram} AS gram, {score} AS score FROM (SELECT {r}.engine, it, beta, x, y, {p} AS p, {w} AS w FROM {r} JOIN {name}_f f ON f.engine = {r}.engine) GROUP BY engine, it"
    return f"""{name}_f AS ({source}),
{name}_d AS (SELECT engine, stddev_pop(y) < 1e-12 AS fixed, count(*) AS n, count(DISTINCT site) AS g FROM {name}_f GROUP BY engine),
{name}_r(engine, it, beta) AS (SELECT engine, 0, {zero} FROM {name}_d UNION ALL SELECT engine, it + 1, {moved} FROM ({_inverse(f"SELECT * FROM ({products(name + '_r')}) WHERE it < {30 if logit else 1}")})),
{name}_b AS (SELECT engine, beta, 0 AS it FROM {name}_r WHERE it = {30 if logit else 1}),
{name}_i AS (SELECT engine, inv FROM ({_inverse(products(name + '_b'))})),
{name}_s AS (SELECT engine, site, {score} AS s, max(abs(y - p)) AS worst FROM (SELECT b.engine, site, x, y, {p} AS p FROM {name}_b b JOIN {name}_f f ON f.engine = b.engine) GROUP BY engine, site),
{name}_m AS (SELECT engine, {_sums(lambda i, j: f"sum(s[{i}] * s[{j}])")} AS meat, max(worst) AS worst FROM {name}_s GROUP BY engine),
{name} AS (SELECT '{name}' AS outcome, d.engine, i, CASE WHEN dead THEN 0e0 ELSE beta[i] END AS beta, CASE WHEN NOT dead THEN sqrt(greatest(0, {_dot("v[i]", "[row[i] for row in inv]")} * (g / (g - 1)) * ((n - 1) / (n - {_K})))) END AS se, n, g AS groups
  FROM (SELECT d.*, b.beta, inv, fixed{'' if logit else ' OR worst < 1e-10'} AS dead, [{", ".join("[" + ", ".join("(" + " + ".join(f"inv[{a}][{c}] * meat[{c}][{b}]" for c in range(1, _K + 1)) + ")" for b in range(1, _K + 1)) + "]" for a in range(1, _K + 1))}] AS v FROM {name}_d d JOIN {name}_b b ON b.engine = d.engine JOIN {name}_i i ON i.engine = d.engine JOIN {name}_m m ON m.engine = d.engine) d, (SELECT unnest([2, 3]) AS i))"""


_X = "[1e0, page_chars, secure, log_n_cited - avg(log_n_cited) OVER (PARTITION BY engine), intent_b, intent_c]"
_ERF = "CASE WHEN abs(z) > 11 THEN 1e0 WHEN z = 0 THEN 0e0 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(0, 250), lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln(abs(z) / sqrt(2)) + lgamma(k + 1) - lgamma(2 * k + 2) - z * z / 2))) END"
MODELS_SQL = (
    with_sql(
        "resp sent cit score",
        "per AS (SELECT score.doc_id, citation_position, avg(CASE WHEN entail_score >= 0.5 THEN 1e0 ELSE 0e0 END) AS share FROM score JOIN sent ON score.doc_id = sent.doc_id AND score.sentence_idx = sent.sentence_idx WHERE NOT is_artifact GROUP BY ALL)",
        "nc AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS nc FROM cit)",
        r"pg AS (SELECT page_id, ln(1 + length(html)) AS page_chars, CAST(starts_with(url, 'https:') AS DOUBLE) AS secure, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS host FROM pages WHERE trim(html) <> '')",
        r"ev AS (SELECT nc.doc_id, nc.page_id, engine, query_id, run_index, share, CAST(nc.citation_position <= 3 AS DOUBLE) AS early3, ln(1 + CAST(nc AS DOUBLE)) AS log_n_cited, page_chars, secure, array_to_string(string_split(host, '.')[-3:], '.') AS site, CAST(ascii(right(query_id, 1)) % 3 = 1 AS DOUBLE) AS intent_b, CAST(ascii(right(query_id, 1)) % 3 = 2 AS DOUBLE) AS intent_c FROM nc JOIN resp ON resp.doc_id = nc.doc_id JOIN pg ON pg.page_id = nc.page_id LEFT JOIN per ON per.doc_id = nc.doc_id AND per.citation_position = nc.citation_position WHERE engine IS NOT NULL AND query_id IS NOT NULL)",
        "kk AS (SELECT engine, query_id, count(*) AS k FROM resp GROUP BY ALL)",
        *(f"{n} AS (SELECT a.*, cited / k AS y FROM (SELECT engine, query_id, {unit}, count(DISTINCT run_index) AS cited, avg(page_chars) AS page_chars, avg(secure) AS secure, avg(log_n_cited) AS log_n_cited, avg(intent_b) AS intent_b, avg(intent_c) AS intent_c{more} FROM ev GROUP BY engine, query_id, {unit}) a JOIN kk ON kk.engine = a.engine AND kk.query_id = a.query_id)" for n, unit, more in (("sp", "page_id", ", min(site) AS site"), ("sd", "site", ""))),
        _model_sql("early3", f"SELECT engine, site, early3 AS y, {_X} AS x FROM ev", True),
        _model_sql("support", f"SELECT engine, site, share AS y, {_X} AS x FROM ev WHERE share IS NOT NULL", False),
        _model_sql("sticky", f"SELECT engine, site, y, {_X} AS x FROM sp", False),
        _model_sql("sticky_domain", f"SELECT engine, site, y, {_X} AS x FROM sd", False),
        "fits AS (SELECT * FROM early3 UNION ALL SELECT * FROM support UNION ALL SELECT * FROM sticky UNION ALL SELECT * FROM sticky_domain)",
        "zs AS (SELECT *, CASE WHEN se > 0 THEN beta / se ELSE 0e0 END AS z FROM fits)",
        f"ps AS (SELECT *, 1 - {_ERF} AS p FROM zs)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY outcome, engine ORDER BY p) AS r, count(*) OVER (PARTITION BY outcome, engine) AS m FROM ps)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT outcome, engine, {FEATURES}[i - 1] AS feature, round(beta, 5) AS beta, round(se, 5) AS se, round(z, 5) AS z, round(p, 5) AS p, round(least(1e0, min(p * m / r) OVER (PARTITION BY outcome, engine ORDER BY r DESC)), 5) AS q, n, groups FROM rk"
)

QUERIES = {"citation_models": (citation_models, MODELS_SQL), "source_linkage": (source_linkage, None)}
