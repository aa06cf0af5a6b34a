"""URL verdicts by host rules and, where no rule fits, a tree of path templates.

Each host's paths form a tree over whole paths, in which every different url counts once.  Segments that look variable (numbers, hashes,
slugs) become wildcards, and so do the children of a node that has many for its urls: ids and words grow in number with
the urls, sections don't.
Urls that a rule decides are the labelled ones: per (host, template) they give counts
of allowed and blocked urls.

Labelled sibling branches of a node are merged when they are alike: most of their rows go on in the same ways, the
distribution of what follows is close to that of all such siblings together (total variation), and the share of blocked rows
doesn't differ significantly from theirs.  Siblings are compared at every segment of a path.  A template's
evidence is that of its merged branch, or its own.  Its purity is smoothed towards its parent node, that
towards the host, that towards all hosts, and that towards one half.  A template is rejected only if its own
evidence has labelled rows: what was labelled elsewhere only never rejects anything.
DataFrame functions only; no step needs a row per pair of urls or of branches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.llm.common import lower_ascii, release, staged, table

#: (host, path, verdict); a rule's name is host + path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A node with CHILDREN children or more has a wildcard if their number is at least the root of that of its urls.
CHILDREN = 8
#: Weight of the prior, least purity that rejects, significance of a difference in standard errors.
WEIGHT, PURITY, ERRORS = 10, 0.9, 3
#: The share of a branch's rows that makes a way on one of its main ways, and the largest distance of branches that are alike.
MAIN, ALIKE = 0.2, 0.25

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Patterns of variable segments and what stands for them; a slug has three hyphens or more, none at its ends or doubled.  In other segments digits are replaced.
_NUMBER, _DIGEST, _NO_SLUG = r"^[0-9]+(\.[A-Za-z0-9]+)?$", r"^[0-9A-Fa-f-]{16,}$", r"^-|--|-$"


def _segment(s: Column) -> Column:
    slug = (F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))) >= 3) & ~s.rlike(_NO_SLUG)
    return F.when(s.rlike(_NUMBER), F.regexp_replace(s, "^[0-9]+", "{n}")).when(s.rlike(_DIGEST), F.lit("{h}")).when(slug, F.lit("{s}")).otherwise(F.regexp_replace(s, "[0-9]+", "{d}"))


def _templates(tree: DataFrame) -> DataFrame:
    """The distinct shapes (sid, host, shape, n, labelled, blocked) with their templates, a staged table.

    Each round finds the nodes with a wildcard of all depths together and takes each shape's first one; what follows it is the next
    round's.  So there are as many rounds as a template has wildcards, however deep the paths are.
    """
    active, ended = staged(tree.select("sid", "host", "n", F.lit("").alias("head"), F.split("shape", "/").alias("seg")), "active"), []
    while True:
        # a node with fewer shapes than CHILDREN has no wildcard at any depth below
        full = active.groupBy("host", "head").agg(F.count("*").alias("shapes")).where(F.col("shapes") >= CHILDREN)
        steps = active.join(full, ["host", "head"], "left_semi").select("sid", "host", "n", "head", F.posexplode("seg").alias("i", "child"))
        above = F.bit_xor(F.xxhash64("i", "child")).over(W.partitionBy("sid").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
        steps = staged(steps.withColumn("prefix", F.coalesce(above, F.lit(0))), "steps")
        node = ["host", "head", "i", "prefix"]
        sizes = steps.groupBy(*node, "child").agg(F.sum("n").alias("n")).groupBy(*node).agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        wild = sizes.where((F.col("k") >= CHILDREN) & (F.col("k") * F.col("k") >= F.col("n")))
        cuts = staged(steps.join(wild.select(*node), node, "left_semi").groupBy("sid").agg(F.min("i").alias("cut")), "cuts")
        if cuts.isEmpty():
            ended.append(active.select("sid", F.concat_ws("/", "head", "seg").alias("template")))
            release(steps, cuts)
            return staged(tree.join(reduce(DataFrame.unionByName, ended), "sid").drop("sid"), "templates")
        ended.append(active.join(cuts, "sid", "left_anti").select("sid", F.concat_ws("/", "head", "seg").alias("template")))
        # the tables of a round stay until its templates are read
        active = staged(active.join(cuts, "sid").select("sid", "host", "n", F.concat_ws("/", "head", F.slice("seg", F.lit(1), F.col("cut")), F.lit("*")).alias("head"), F.slice("seg", F.col("cut") + 2, F.size("seg")).alias("seg")), "active")
        release(steps)


def _judged(templates: DataFrame) -> DataFrame:
    """(host, template, reject, basis) of (tid, host, template, n, labelled, blocked), one row for each template.

    Every segment of a template is a branch once, between the node before it and the suffix after it.  Nodes and suffixes are digests
    of 64 bits within a host and place, so a path takes rows in proportion to its length; hosts without labelled rows take none.
    """
    sums = lambda df, p, *key: df.groupBy(*key).agg(F.sum("labelled").alias(f"{p}_l"), F.sum("blocked").alias(f"{p}_b"))
    t = templates.withColumn("seg", F.split("template", "/")).withColumn("seg", F.slice("seg", 2, F.size("seg")))
    hosts = sums(templates, "h", "host")
    marks = F.aggregate(F.transform("seg", lambda s, i: F.xxhash64(i, s)), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    # the digest of a whole path is taken before its segments become rows
    steps = t.join(hosts.where("h_l > 0"), "host", "left_semi").withColumn("marks", marks).select("tid", "host", "n", "labelled", "blocked", "marks", F.posexplode("seg").alias("i", "branch"))
    before = F.bit_xor(F.xxhash64("i", "branch")).over(W.partitionBy("tid").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    steps = steps.withColumn("node", F.coalesce(before, F.lit(0)))
    steps = staged(steps.withColumn("suffix", F.col("marks").bitwiseXOR(F.col("node")).bitwiseXOR(F.xxhash64("i", "branch"))).drop("marks"), "steps")
    node, branch = ["host", "i", "node"], ["host", "i", "node", "branch"]
    labelled = steps.groupBy(*branch).agg(F.sum("n").alias("b_n"), F.sum("labelled").alias("b_l"), F.sum("blocked").alias("b_b")).where("b_l > 0")
    # a node with one labelled branch has none to merge
    nodes = labelled.groupBy(*node).agg(F.count("*").alias("k")).where("k > 1").select(*node)
    labelled = staged(labelled.join(nodes, node, "left_semi"), "labelled")
    split = staged(steps.join(labelled.select(*branch), branch, "left_semi"), "branches")
    release(steps)
    main = split.join(labelled, branch).where(F.col("n") >= MAIN * F.col("b_n")).groupBy(*branch).agg(F.array_sort(F.collect_list("suffix")).alias("kind"))
    # no main way is as the end of the path
    labelled = labelled.join(main, branch, "left").withColumn("kind", F.coalesce("kind", F.array(F.lit(0).cast("long"))))
    kin = [*node, "kind"]
    pool = labelled.groupBy(*kin).agg(F.sum("b_n").alias("p_n"), F.sum("b_l").alias("p_l"), F.sum("b_b").alias("p_b"), F.count("*").alias("k")).where("k > 1").drop("k")
    several = staged(labelled.join(pool, kin), "siblings")
    of_pool = split.join(several.select(*branch, "kind"), branch).groupBy(*kin, "suffix").agg(F.sum("n").alias("s_n"))
    near = split.join(several, branch).join(of_pool, [*kin, "suffix"])
    share = F.col("s_n") / F.col("p_n")
    near = near.groupBy(*branch, "kind", "b_l", "b_b", "p_l", "p_b").agg(F.round((F.sum(F.abs(F.col("n") / F.col("b_n") - share)) + 1 - F.sum(share)) / 2, 9).alias("away"))
    blocked = F.col("p_b") / F.col("p_l")
    gap = F.col("b_b") - F.col("b_l") * blocked
    alike = near.where((F.col("away") <= ALIKE) & (F.round(gap * gap - ERRORS * ERRORS * F.col("b_l") * blocked * (1 - blocked), 9) <= 0)).select(*branch, "kind")
    within = split.join(alike, branch)
    merged = within.groupBy(*kin, "suffix").agg(F.sum("labelled").alias("m_l"), F.sum("blocked").alias("m_b"))
    best = within.join(merged, [*kin, "suffix"]).groupBy("tid").agg(F.max(F.struct("m_l", "i", "m_b")).alias("best"))
    ends = t.select("tid", "host", F.size("seg").alias("i"), F.array_join(F.slice("seg", F.lit(1), F.size("seg") - 1), "/").alias("node"), "labelled", "blocked")
    parent = ends.join(sums(ends, "u", *node), node).select("tid", "u_l", "u_b")
    whole = templates.join(parent, "tid").join(best, "tid", "left").join(hosts, "host")
    whole = whole.withColumn("a", templates.agg(F.struct(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))).scalar())
    smooth = lambda b, l, prior: (b + WEIGHT * prior) / (l + WEIGHT)
    found, seen = F.coalesce("best.m_b", "blocked"), F.coalesce("best.m_l", "labelled")
    everywhere = smooth(F.coalesce("a.b", F.lit(0)), F.coalesce("a.l", F.lit(0)), F.lit(0.5))
    purity = smooth(found, seen, smooth(F.col("u_b"), F.col("u_l"), smooth(F.col("h_b"), F.col("h_l"), everywhere)))
    basis = F.when(seen > F.col("labelled"), "merged").when(seen > 0, "own").otherwise("unlabelled")
    return whole.select("host", "template", ((seen > 0) & (F.round(purity, 9) > PURITY)).alias("reject"), basis.alias("basis"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, template, basis.

    The longest rule that fits decides; template is null then, and basis is 'rule'.  Without a rule the
    verdict is the template's, and basis says whose labelled rows it rests on: the template's 'own', those of its
    'merged' branch, or none ('unlabelled', always allowed).  A null url or one without ``://`` has an empty host and
    path, the template of the empty path, and that verdict.  Null and repeated ids
    come back as they are.  Urls may have any length.  An empty table gives an empty result.
    Repeated urls count once, so verdicts stay the same however often all rows are repeated.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), lower_ascii(F.regexp_extract(url, _URL, 1)).alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, word in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, word).otherwise(verdict)
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    rows = rows.select("*", rule.alias("rule"), verdict.alias("label"), F.array_join(F.transform(parts, _segment), "/").alias("shape"))
    # the tree works on the distinct shapes of each host, and counts different urls, with map-side combining
    urls = rows.select("host", "path", "shape", "label").distinct()
    tree = staged(urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")).withColumn("sid", F.monotonically_increasing_id()), "shapes")
    shapes = _templates(tree)
    templates = staged(shapes.groupBy("host", "template").agg(*(F.sum(c).cast("double").alias(c) for c in ("n", "labelled", "blocked"))).withColumn("tid", F.monotonically_increasing_id()), "counted")
    known = staged(shapes.select("host", "shape", "template").join(_judged(templates), ["host", "template"]), "verdicts")
    none = F.lit(None).cast("string").alias("template")
    ruled = rows.where("rule is not null").select("page_id", "host", "path", "rule", F.col("label").alias("verdict"), none, F.lit("rule").alias("basis"))
    rest = rows.where("rule is null").join(known, ["host", "shape"]).select("page_id", "host", "path", "rule", F.when(F.col("reject"), "block").otherwise("allow").alias("verdict"), "template", "basis")
    return ruled.unionByName(rest)


def op5_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


#: Levels that OP5_SQL unrolls; deeper segments of a path stay as they are.
SQL_LEVELS = 6


def _sql() -> str:
    when = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    seg = (
        f"CASE WHEN regexp_matches(s, '{_NUMBER}') THEN regexp_replace(s, '^[0-9]+', '{{n}}') WHEN regexp_matches(s, '{_DIGEST}') THEN '{{h}}'"
        f" WHEN length(s) - length(replace(s, '-', '')) >= 3 AND NOT regexp_matches(s, '{_NO_SLUG}') THEN '{{s}}' ELSE regexp_replace(s, '[0-9]+', '{{d}}', 'g') END"
    )
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sql = f"""
WITH url AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{upper}', '{low}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
r AS (
  SELECT *, CASE {" ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in when)} END AS rule, CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in when)} END AS label,
    string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM url),
sh AS (SELECT page_id, host, path, rule, label, array_to_string(list_transform(parts, lambda s: {seg}), '/') AS shape FROM r),
l0 AS (
  SELECT host, shape, count(*) AS n, count(label) AS labelled, count(*) FILTER (label = 'block') AS blocked, string_split(shape, '/') AS seg, '' AS template
  FROM (SELECT DISTINCT host, path, shape, label FROM sh) GROUP BY host, shape)"""
    for i in range(SQL_LEVELS):
        sql += f""",
w{i} AS (
  SELECT host, template FROM (SELECT host, template, seg[{i + 1}] AS child, sum(n) AS n FROM l{i} WHERE len(seg) > {i} GROUP BY ALL)
  GROUP BY ALL HAVING count(*) >= {CHILDREN} AND count(*) * count(*) >= sum(n)),
l{i + 1} AS (
  SELECT l.host, shape, n, labelled, blocked, seg, CASE WHEN len(seg) <= {i} THEN l.template ELSE concat_ws('/', l.template, CASE WHEN w.host IS NOT NULL THEN '*' ELSE seg[{i + 1}] END) END AS template
  FROM l{i} l LEFT JOIN w{i} w ON l.host = w.host AND l.template = w.template)"""
    smooth = lambda b, l, prior: f"(({b}) + {WEIGHT} * {prior}) / (({l}) + {WEIGHT})"
    purity = smooth("b", "l", smooth("u_b", "u_l", smooth("h_b", "h_l", smooth("a_b", "a_l", "0.5"))))
    return (
        sql
        + f""",
t AS (SELECT host, shape, n, labelled, blocked, CASE WHEN len(seg) > {SQL_LEVELS} THEN template || '/' || array_to_string(seg[{SQL_LEVELS + 1}:], '/') ELSE template END AS template FROM l{SQL_LEVELS}),
tm AS (SELECT host, template, sum(n)::DOUBLE AS n, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked FROM t GROUP BY ALL),
pl AS (SELECT *, unnest(list_distinct(list_filter([1, len(seg) - 1, len(seg)], lambda x: x >= 1))) AS i FROM (SELECT *, string_split(template, '/')[2:] AS seg FROM tm)),
sp AS (
  SELECT host, template, n, labelled, blocked, i = len(seg) AS last, i, array_to_string(list_slice(seg, 1, i - 1), '/') AS node, seg[i] AS branch, array_to_string(list_slice(seg, i + 1, len(seg)), '/') AS suffix FROM pl),
br AS (SELECT host, i, node, branch, sum(n) AS b_n, sum(labelled) AS b_l, sum(blocked) AS b_b FROM sp GROUP BY ALL HAVING sum(labelled) > 0),
mn AS (SELECT host, i, node, branch, string_agg(suffix, chr(10) ORDER BY suffix) AS kind FROM sp JOIN br USING (host, i, node, branch) WHERE n >= {MAIN} * b_n GROUP BY ALL),
bk AS (SELECT br.*, coalesce(kind, '') AS kind FROM br LEFT JOIN mn USING (host, i, node, branch)),
po AS (SELECT host, i, node, kind, sum(b_n) AS p_n, sum(b_l) AS p_l, sum(b_b) AS p_b FROM bk GROUP BY ALL HAVING count(*) > 1),
sb AS (SELECT * FROM bk JOIN po USING (host, i, node, kind)),
di AS (SELECT host, i, node, kind, suffix, sum(n) AS s_n FROM sp JOIN sb USING (host, i, node, branch) GROUP BY ALL),
aw AS (
  SELECT host, i, node, branch, kind, b_l, b_b, p_l, p_b, (sum(abs(n / b_n - s_n / p_n)) + 1 - sum(s_n / p_n)) / 2 AS away
  FROM sp JOIN sb USING (host, i, node, branch) JOIN di USING (host, i, node, kind, suffix) GROUP BY ALL),
al AS (
  SELECT host, i, node, branch, kind FROM aw
  WHERE round(away, 9) <= {ALIKE} AND round((b_b - b_l * p_b / p_l) * (b_b - b_l * p_b / p_l) - {ERRORS * ERRORS} * b_l * (p_b / p_l) * (1 - p_b / p_l), 9) <= 0),
wi AS (SELECT sp.*, kind FROM sp JOIN al USING (host, i, node, branch)),
me AS (SELECT host, i, node, kind, suffix, sum(labelled) AS m_l, sum(blocked) AS m_b FROM wi GROUP BY ALL),
be AS (SELECT host, template, m_l, m_b FROM wi JOIN me USING (host, i, node, kind, suffix) QUALIFY row_number() OVER (PARTITION BY host, template ORDER BY m_l DESC, i DESC) = 1),
pa AS (SELECT host, i, node, sum(labelled) AS u_l, sum(blocked) AS u_b FROM sp WHERE last GROUP BY ALL),
ho AS (SELECT host, sum(labelled) AS h_l, sum(blocked) AS h_b FROM tm GROUP BY ALL),
ev AS (SELECT coalesce(sum(labelled), 0) AS a_l, coalesce(sum(blocked), 0) AS a_b FROM tm),
q AS (
  SELECT sp.host, sp.template, sp.labelled, coalesce(m_l, sp.labelled) AS l, coalesce(m_b, sp.blocked) AS b, u_l, u_b, h_l, h_b, a_l, a_b
  FROM sp JOIN pa USING (host, i, node) JOIN ho USING (host) CROSS JOIN ev LEFT JOIN be ON be.host = sp.host AND be.template = sp.template WHERE last),
v AS (
  SELECT host, template, l > 0 AND round({purity}, 9) > {PURITY} AS reject, CASE WHEN l > labelled THEN 'merged' WHEN l > 0 THEN 'own' ELSE 'unlabelled' END AS basis FROM q)
SELECT page_id, host, path, rule, label AS verdict, NULL::VARCHAR AS template, 'rule' AS basis FROM sh WHERE rule IS NOT NULL
UNION ALL
SELECT page_id, sh.host, path, rule, CASE WHEN reject THEN 'block' ELSE 'allow' END AS verdict, t.template, basis
FROM sh JOIN t ON sh.host = t.host AND sh.shape = t.shape JOIN v ON t.host = v.host AND t.template = v.template WHERE rule IS NULL
"""
    )


OP5_SQL = _sql()
