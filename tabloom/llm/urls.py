"""URL filters (5): host rules, then empirical-Bayes host reputation, in SQL functions only.

Labelled page outcomes (good or not) are counted by host. A beta-binomial prior is carried down from all pages to public
suffix, registered domain and host: each level is shrunk towards the one above with a strength from the spread between its
units (method of moments). A page that no rule judges is blocked if the upper posterior bound of its host is under
MIN_GOOD; a host without a label has the bound that its domain, else its suffix, else all pages give it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut, join_hot

MIN_GOOD, Z = 0.8, 1.6448536269514722
#: Rules are a literal of the plan.
MOST_RULES = 10_000
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Common public suffixes of two labels; any other list can be given. All last labels are suffixes.
SUFFIXES = tuple(
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.au edu.au gov.au id.au net.au org.au ac.nz co.nz govt.nz net.nz org.nz "
    "ac.jp ad.jp co.jp ed.jp go.jp ne.jp or.jp com.br edu.br gov.br net.br org.br ac.cn com.cn edu.cn gov.cn net.cn org.cn com.hk edu.hk org.hk com.tw edu.tw org.tw "
    "com.sg edu.sg com.my edu.my co.in ac.in gov.in net.in org.in co.kr ac.kr or.kr co.za ac.za org.za com.mx org.mx com.ar com.tr edu.tr co.il ac.il org.il co.id ac.id "
    "com.pl edu.pl com.ua com.ru com.es org.es com.pt com.gr com.eg com.ng com.pk com.ph com.vn com.co com.pe com.ve co.th ac.th github.io gitlab.io blogspot.com".split()
)
MOST_SUFFIXES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        by_host.setdefault(rule.split("/", 1)[0], []).append((rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<n int, rule string, verdict string>")
    one = lambda r, v: F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
    lists = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[one(r, v) for r, v in rs]))])
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(lists, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(fits, lambda r: F.startswith(path, F.substr(r["rule"], F.instr(r["rule"], "/")))))


def site_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """struct(domain, suffix): the registered domain and public suffix, without user, port and last dot.

    A number address is its own domain, and a name that is a suffix too; addresses have the suffix "address"."""
    if len(suffixes) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffixes")
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    two = last(2).isin(*suffixes) if suffixes else F.lit(False)
    address = name.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$")
    domain = F.when(address, name).when(two, last(3)).otherwise(last(2))
    return F.struct(domain.alias("domain"), F.when(address, F.lit("address")).when(two, last(2)).otherwise(last(1)).alias("suffix"))


def _strengths(hosts: DataFrame) -> dict:
    """Of labelled hosts (host, domain, suffix, n, k): n0 and k0 altogether, and s1, s2, s3: the pseudo-counts of the priors
    of suffixes, domains and hosts."""
    units = [hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(F.lit(i + 1).alias("level"), "n", "k") for i, by in enumerate((["suffix"], ["suffix", "domain"], ["host"]))]
    sums = units[0].unionByName(units[1]).unionByName(units[2]).groupBy("level")
    sums = sums.agg(F.count("*").alias("m"), F.sum("n").alias("nn"), F.sum("k").alias("k0"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
    out = {"n0": 0.0, "k0": 0.0}
    for r in sums.collect():  # three rows
        n0, k0 = float(r["nn"]), float(r["k0"])
        p = k0 / n0
        scale = n0 - r["n2"] / n0 - (r["m"] - 1)
        rho = ((r["kk"] - k0 * p) / (p * (1 - p)) - (r["m"] - 1)) / scale if p * (1 - p) > 0 and scale > 0 else 0.0
        out |= {"n0": n0, "k0": k0, f"s{r['level']}": 1 / min(max(rho, 0.001), 0.5) - 1}
    return out


def _upper(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.round(a / (a + b) + Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6))


def reputation(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """hosts (host, pages, n labelled, k of them good) -> host, pages, n_labelled, bound; bound is null without any label."""
    hosts = cut(hosts.withColumn("site", site_of(F.col("host"), suffixes)).select("host", "pages", "n", "k", "site.domain", "site.suffix"), "hosts")
    x = _strengths(hosts.where("n > 0"))
    if not x["n0"]:
        return hosts.select("host", "pages", F.col("n").alias("n_labelled"), F.lit(None).cast("double").alias("bound"))
    overall = x["k0"] / x["n0"]
    by_suffix = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_distinct("domain").alias("domains"))
    by_suffix = cut(by_suffix.select("suffix", "domains", ((F.col("k") + x["s1"] * x["k0"] / x["n0"]) / (F.col("n") + x["s1"])).alias("m1")), "suffixes")
    by_domain = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("hosts"))
    totals = by_suffix.agg(F.sum("domains")).first()[0]
    m2 = (F.col("k") + x["s2"] * F.coalesce("m1", F.lit(overall))) / (F.col("n") + x["s2"])
    by_domain = cut(join_hot(by_domain, by_suffix, "suffix", totals, "domains").select("domain", "hosts", m2.alias("m2")), "domains")
    found = join_hot(hosts, by_domain, "domain", by_domain.agg(F.sum("hosts")).first()[0], "hosts")
    a, b = F.col("k") + x["s3"] * F.col("m2"), F.col("n") - F.col("k") + x["s3"] * (1 - F.col("m2"))
    return found.select("host", "pages", F.col("n").alias("n_labelled"), _upper(a, b).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, min_good: float = MIN_GOOD, id_col: str = "page_id", url_col: str = "url", suffixes: Sequence[str] = SUFFIXES, good_col: str | None = None) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, n_labelled, upper_bound.

    Labels (0 or 1; null and other values are none) come from good_col of pages, one for each row, or from outcomes (page_id,
    good), each of which counts once for each host that its page id has. A null url or one without :// has an empty host and
    path, fits no rule and is judged as the host "". A host without a label is judged by the bound that its domain or suffix
    gives it; upper_bound, the evidence of its own pages, is null. Without any label all are allowed. Repeated rows are judged
    alike, and their labels count as often as they stand. An empty table gives an empty table. Other columns are not read.

    upper_bound is the mean and Z standard deviations of the posterior, 1 at most: a normal approximation.
    """
    label = F.col(good_col).cast("int") if good_col else F.lit(None).cast("int")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), label.alias("good"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "good")
    counted = lambda good: [good.isin(0, 1).cast("int").alias("n"), (good == 1).cast("int").alias("k")]
    each = rows.select("host", F.lit(1).alias("pages"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counted(F.col("good")), "nk", strict=True)])
    if outcomes is not None:
        good = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("int").alias("good")).where("good IN (0, 1) AND page_id IS NOT NULL")
        by_page = good.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
        each = each.unionByName(rows.select("page_id", "host").distinct().join(by_page, "page_id").select("host", F.lit(0).alias("pages"), "n", "k"))
    known = cut(reputation(each.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "k")]), suffixes), "reputation")
    total = known.agg(F.sum("pages")).first()[0] or 0
    out = join_hot(rows.drop("good"), known, "host", total, "pages").withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    upper = F.when(F.col("n_labelled") > 0, F.col("bound")).alias("upper_bound")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), F.col("n_labelled").cast("long").alias("n_labelled"), upper)


def with_quality(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, good of each row of pages: the quality label of the document whose number ends the path, else null.

    Rows of a number that many pages share get their label where they are."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:/|\.html)?$", 1)
    rows = pages.select("page_id", "url", F.when(number != "", number).cast("long").alias("doc_id"))
    held = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("good"))
    side = cut(held.join(marks, "doc_id"), "quality")
    total = side.agg(F.sum("n")).first()[0] or 0
    return join_hot(rows, side, "doc_id", total, "n", "left").select("page_id", "url", "good")


#: The same judgement for DuckDB.
SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
q AS (SELECT page_id, regexp_extract(path, '/([0-9]{{1,18}})(?:/|\\.html)?$', 1) AS num, host FROM p),
good AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id),
l AS (SELECT host, good FROM q JOIN good ON CASE WHEN num <> '' THEN CAST(num AS BIGINT) END = doc_id WHERE good IN (0, 1)),
h AS (SELECT host, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, regexp_replace(host, '^.*@|:[0-9]*$|\\.$', '', 'g') AS name
      FROM (SELECT host, 0 AS n, 0 AS k FROM p UNION ALL SELECT host, 1, good FROM l) GROUP BY host),
site AS (SELECT *, regexp_matches(name, '^(?:[0-9]+(?:\\.[0-9]+){{3}}|\\[.*)$') AS address, string_split(name, '.') AS r, len(string_split(name, '.')) AS m FROM h),
ends AS (SELECT *, array_to_string(r[greatest(m - 1, 1):], '.') AS last2, array_to_string(r[greatest(m - 2, 1):], '.') AS last3 FROM site),
hosts AS (SELECT host, n, k, CASE WHEN address THEN 'address' WHEN last2 IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN last2 ELSE r[m] END AS suffix,
        CASE WHEN address THEN name WHEN last2 IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN last3 ELSE last2 END AS domain FROM ends),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
total AS (SELECT sum(n) AS n0, sum(k) AS k0 FROM suffixes),
units AS (SELECT 1 AS lv, n, k FROM suffixes UNION ALL SELECT 2, n, k FROM domains UNION ALL SELECT 3, n, k FROM hosts),
st AS (SELECT lv, count(*) AS m, sum(n) AS nn, sum(n * n) AS n2, sum(k * k / n) AS kk FROM units WHERE n > 0 GROUP BY lv),
rho AS (SELECT lv, CASE WHEN k0 / n0 * (1 - k0 / n0) > 0 AND nn - n2 / nn - (m - 1) > 0
        THEN ((kk - k0 * (k0 / n0)) / (k0 / n0 * (1 - k0 / n0)) - (m - 1)) / (nn - n2 / nn - (m - 1)) END AS rho FROM st, total),
s AS (SELECT lv, 1 / least(greatest(coalesce(rho, 0.0), 0.001), CAST(0.5 AS DOUBLE)) - 1 AS s FROM rho),
b1 AS (SELECT suffix, (k + s * k0 / n0) / (n + s) AS m1 FROM suffixes, total, s WHERE lv = 1),
b2 AS (SELECT domain, (k + s * m1) / (n + s) AS m2 FROM domains JOIN b1 USING (suffix), s WHERE lv = 2),
b3 AS (SELECT host, CAST(n AS BIGINT) AS n_labelled, k + s * m2 AS a, n - k + s * (1 - m2) AS b FROM hosts JOIN b2 USING (domain), s WHERE lv = 3),
rep AS (SELECT host, n_labelled, least(CAST(1 AS DOUBLE), round(a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6)) AS bound FROM b3),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)}) AS x(verdict, rule, h, pa)),
fit AS (SELECT DISTINCT host, path, first(rule ORDER BY length(rule) DESC) OVER (PARTITION BY host, path ORDER BY length(rule) DESC) AS rule
        FROM (SELECT DISTINCT host, path FROM p) d JOIN rules ON (d.host = h OR ends_with(d.host, '.' || h)) AND starts_with(d.path, pa))
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(rules.verdict, CASE WHEN rep.bound < {MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_labelled, 0) AS n_labelled, CASE WHEN n_labelled > 0 THEN bound END AS upper_bound
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path LEFT JOIN rules ON rules.rule = fit.rule LEFT JOIN rep ON rep.host = p.host
"""
