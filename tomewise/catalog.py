"""The analysis operators as queries over the driver's tables, with the same results in DuckDB's SQL.

Skills are a view over `documents` (CORPUS): one skill for each source. Its SQL runs unchanged on both engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions import columns as C
from .functions import yaml12
from .functions.store import table_store
from .operators import diagnostics, frontmatter, manifest, references
from .plans import render
from .plans.analyze import Options, analyze

CORPUS = """
WITH d AS (
  SELECT doc_id, text, source AS skill_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
p AS (
  SELECT *, CASE
      WHEN rn = 1 THEN 'SKILL.md' WHEN rn = 2 THEN 'README.md' WHEN rn = 3 THEN 'LICENSE'
      WHEN doc_id % 4 = 0 THEN concat('references/d', CAST(doc_id AS STRING), '.md')
      WHEN doc_id % 4 = 1 THEN concat('scripts/d', CAST(doc_id AS STRING), '.py')
      WHEN doc_id % 4 = 2 THEN concat('assets/d', CAST(doc_id AS STRING), '.txt')
      ELSE concat('d', CAST(doc_id AS STRING), '.md') END AS path
  FROM d),
n AS (
  SELECT *, lead(path) OVER (PARTITION BY skill_id ORDER BY rn) AS next_path,
         max(CASE WHEN rn = 4 THEN path END) OVER (PARTITION BY skill_id) AS first_path
  FROM p)
SELECT skill_id, path, CASE
    WHEN rn = 1 THEN concat('---', chr(10), 'name: ', skill_id, chr(10), 'description: Synthetic skill ', skill_id, chr(10),
         'metadata:', chr(10), '  version: "1.0.', CAST(doc_id AS STRING), '"', chr(10), '---', chr(10), chr(10),
         '# Skill ', skill_id, chr(10), chr(10), '## Files', chr(10), chr(10),
         'See [first](', coalesce(first_path, 'none.md'), '), [gone](references/gone.md), [shared](../shared/SKILL.md) and `README.md`',
         chr(10), chr(10), text)
    WHEN doc_id % 5 <> 0 AND next_path IS NOT NULL AND rn > 3 THEN concat(text, chr(10), 'Next: ', next_path, chr(10))
    ELSE text END AS text
FROM n
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CORPUS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("skill_id", F.col("skill_id").alias("dir"), "path", F.encode("text", "UTF-8").alias("content"))


def with_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = manifest.visible(files(spark, sf_dir))
    return seen.join(manifest.picks(seen), "skill_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH c AS ({CORPUS}) {sql}" if re.search(r"\b(?:FROM|JOIN) c\b", sql) and not re.match(r"WITH (?:RECURSIVE )?c AS", sql) else sql
        return f

    return add


KIND = """CASE WHEN path = 'SKILL.md' THEN 'instructions' WHEN path = 'README.md' THEN 'readme' WHEN path = 'LICENSE' THEN 'license'
  WHEN starts_with(path, 'scripts/') THEN 'script' WHEN starts_with(path, 'references/') THEN 'reference' WHEN starts_with(path, 'assets/') THEN 'asset' ELSE 'other' END"""


@query(f"SELECT skill_id, path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, {KIND} AS kind, true AS is_text FROM c ")
def manifest_entries(spark, sf_dir):
    return manifest.entries(with_picks(spark, sf_dir)).withColumnRenamed("isText", "is_text")


@query(f"SELECT skill_id, {KIND} AS kind, CAST(sum(strlen(text)) AS BIGINT) AS size FROM c GROUP BY ALL")
def size_by_kind(spark, sf_dir):
    return manifest.entries(with_picks(spark, sf_dir)).groupBy("skill_id", "kind").agg(F.sum("size").alias("size"))


@query("SELECT skill_id, CAST(sum(strlen(text)) AS BIGINT) AS total, CAST(sum(CASE WHEN path = 'SKILL.md' THEN strlen(text) END) AS BIGINT) AS instructions FROM c GROUP BY skill_id")
def size_total(spark, sf_dir):
    return manifest.sizes(manifest.entries(with_picks(spark, sf_dir))).select("skill_id", F.col("size.total").alias("total"), F.col("size.byKind.instructions").alias("instructions"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_cost(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_cost_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(C.approx_tokens(F.col("text"))).alias("tokens"))


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS lines FROM documents")
def body_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.line_count(F.col("text")).alias("lines"))


@query(
    """SELECT doc_id, 'body-too-long' AS code, concat('SKILL.md body is approximately ', CAST(CAST(ceil(length(text) / 4.0) AS BIGINT) AS VARCHAR), ' tokens; recommended maximum is 4000.') AS message
    FROM documents WHERE ceil(length(text) / 4.0) > 4000
    UNION ALL SELECT doc_id, 'body-too-many-lines', concat('SKILL.md body has ', CAST(len(string_split(text, chr(10))) AS VARCHAR), ' lines; recommended maximum is 40.') FROM documents WHERE len(string_split(text, chr(10))) > 40"""
)
def body_budgets(spark, sf_dir):
    """The line limit is a parameter here (40), as no document has 500 lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", C.approx_tokens(F.col("text")).alias("tokens"), C.line_count(F.col("text")).alias("lines"))
    long = docs.where("tokens > 4000").select("doc_id", F.lit("body-too-long").alias("code"), F.format_string("SKILL.md body is approximately %d tokens; recommended maximum is 4000.", "tokens").alias("message"))
    return long.unionByName(docs.where("lines > 40").select("doc_id", F.lit("body-too-many-lines").alias("code"), F.format_string("SKILL.md body has %d lines; recommended maximum is 40.", "lines").alias("message")))


@query("SELECT skill_id, path FROM c WHERE path NOT LIKE 'assets/%'")
def ignore_filter(spark, sf_dir):
    return manifest.visible(files(spark, sf_dir), ("assets", ".git")).select("skill_id", "path")


@query("SELECT skill_id, path, concat(path, ': ', CAST(strlen(text) AS VARCHAR), ' bytes exceeds maxFileBytes (4096).') AS message FROM c WHERE strlen(text) > 4096")
def file_size_guard(spark, sf_dir):
    return manifest.too_large(files(spark, sf_dir), 4096).select("skill_id", F.col("field").alias("path"), "message")


PICKS = (
    "VALUES ('a','README.md'),('a','README.en.md'),('a','LICENSE.md'),('a','COPYING'),('b','readme.zh-CN.md'),('b','docs/README.md'),('b','README.txt'),('c','ReadMe'),('c','license.TXT'),('c','src/LICENSE')"
)


@query(
    f"""WITH v(skill_id, path) AS ({PICKS}) SELECT skill_id,
    coalesce(min(path) FILTER (NOT contains(path, '/') AND lower(path) IN ('readme.md', 'readme')), min(path) FILTER (NOT contains(path, '/') AND regexp_full_match(lower(path), 'readme[.][a-z]{{2,3}}(-[a-z]{{2,4}})?[.]md'))) AS readme,
    min(path) FILTER (NOT contains(path, '/') AND lower(path) IN ('license', 'license.txt', 'license.md', 'copying')) AS license FROM v GROUP BY skill_id"""
)
def readme_license_picks(spark, sf_dir):
    return manifest.picks(spark.sql(f"SELECT * FROM ({PICKS}) AS v(skill_id, path)")).select("skill_id", "readme", "license")


@query(
    """SELECT doc_id, CASE WHEN contains(h, 'mit license') THEN 'MIT' WHEN contains(h, 'apache license') AND contains(h, 'version 2.0') THEN 'Apache-2.0'
    WHEN contains(h, 'gnu general public license') AND contains(h, 'version 3') THEN 'GPL-3.0-only' WHEN contains(h, 'gnu general public license') AND contains(h, 'version 2') THEN 'GPL-2.0-only'
    WHEN contains(h, 'mozilla public license') AND contains(h, '2.0') THEN 'MPL-2.0' WHEN contains(h, 'bsd 3-clause') THEN 'BSD-3-Clause' WHEN contains(h, 'bsd 2-clause') THEN 'BSD-2-Clause'
    WHEN contains(h, 'isc license') THEN 'ISC' WHEN contains(h, 'this is free and unencumbered software released into the public domain') THEN 'Unlicense' END AS spdx
    FROM (SELECT doc_id, lower(array_to_string(string_split(text, chr(10))[1:20], chr(10))) AS h FROM documents)"""
)
def spdx_classify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.spdx_of_head(C.license_head(F.col("text"))).alias("spdx"))


def skills(spark, sf_dir) -> DataFrame:
    return frontmatter.parsed(corpus(spark, sf_dir).where("path = 'SKILL.md'").select("skill_id", F.col("skill_id").alias("dir"), "text"))


@query(
    """SELECT skill_id, CAST(length(regexp_extract(line, '^(#{1,6}) (.+)', 1)) AS INTEGER) AS depth, trim(regexp_extract(line, '^(#{1,6}) (.+)', 2)) AS title
    FROM (SELECT skill_id, unnest(string_split(text, chr(10))) AS line FROM c WHERE path = 'SKILL.md') WHERE regexp_matches(line, '^#{1,6} .')"""
)
def headings(spark, sf_dir):
    return skills(spark, sf_dir).select("skill_id", F.explode("headings").alias("h")).select("skill_id", "h.depth", F.col("h.text").alias("title"))


MARKED = """concat('```py', chr(10), '# no heading', chr(10), '[no](no.md)', chr(10), '```', chr(9), chr(10), '## Part ', CAST(doc_id AS STRING), ' ##', chr(10), 'See [a](a', CAST(doc_id AS STRING), '.md "T"), [b](<b c.md>), ``x`y``, [d]( d.md ) and `[e](e.md)`',
  chr(10), '~~~', chr(10), '`no`', chr(10), '   ~~~~ ', chr(10), '#', chr(9), 'none', chr(10), text)"""


@query(
    """SELECT doc_id, 'heading' AS kind, concat('2 Part ', CAST(doc_id AS VARCHAR)) AS value FROM documents
    UNION ALL SELECT doc_id, 'heading', concat(CAST(length(regexp_extract(line, '^(#{1,6}) (.+)', 1)) AS VARCHAR), ' ', trim(regexp_extract(line, '^(#{1,6}) (.+)', 2))) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^#{1,6} .')
    UNION ALL SELECT doc_id, 'link', concat('a', CAST(doc_id AS VARCHAR), '.md') FROM documents UNION ALL SELECT doc_id, 'link', unnest(['b c.md', 'd.md']) FROM documents UNION ALL SELECT doc_id, 'code', unnest(['x`y', '[e](e.md)']) FROM documents"""
)
def markdown_scan(spark, sf_dir):
    """Fences, headings, links and code spans of every document, behind a part that has all kinds of them."""
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as skill_id", f"{MARKED} as text").withColumn("dir", F.lit(None).cast("string"))
    found = frontmatter.parsed(docs).select(F.col("skill_id").cast("long").alias("doc_id"), "headings", "link_targets", "inline_code")
    titles = F.transform("headings", lambda h: F.concat(h["depth"].cast("string"), F.lit(" "), h["text"]))
    parts = [found.select("doc_id", F.lit(kind).alias("kind"), F.explode(c).alias("value")) for kind, c in (("heading", titles), ("link", F.col("link_targets")), ("code", F.col("inline_code")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT skill_id, unnest(regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS target FROM c WHERE path = 'SKILL.md'")
def link_targets(spark, sf_dir):
    return skills(spark, sf_dir).select("skill_id", F.explode("link_targets").alias("target"))


@query("SELECT skill_id, unnest(regexp_extract_all(text, '`([^`]+)`', 1)) AS code FROM c WHERE path = 'SKILL.md'")
def inline_code(spark, sf_dir):
    return skills(spark, sf_dir).select("skill_id", F.explode("inline_code").alias("code"))


@query(
    """SELECT l.skill_id, l.target, CASE WHEN starts_with(l.target, '../') THEN 'external' WHEN EXISTS (SELECT 1 FROM c WHERE c.skill_id = l.skill_id AND c.path = l.target) THEN 'resolved' ELSE 'broken' END AS status
    FROM (SELECT DISTINCT skill_id, unnest(regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS target FROM c WHERE path = 'SKILL.md') l"""
)
def link_resolution(spark, sf_dir):
    links = skills(spark, sf_dir).select("skill_id", F.explode("link_targets").alias("target"))
    return references.resolution(links, corpus(spark, sf_dir))


@query(
    """SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
    WHERE href <> '' AND NOT starts_with(href, '#') AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:')"""
)
def relative_hrefs(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.where(C.is_relative(F.col("href")))


@query(
    """SELECT skill_id, path, string_split(path, '/')[-1] AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder,
    CASE WHEN contains(path, '/') AND ends_with(path, '.py') THEN replace(regexp_replace(path, '[.]py$', ''), '/', '.') END AS module FROM c """
)
def path_functions(spark, sf_dir):
    p = F.col("path")
    return corpus(spark, sf_dir).select("skill_id", "path", C.basename(p).alias("base"), C.dirname(p).alias("folder"), C.python_module(p).alias("module"))


PATHS = "VALUES ('a/../b.md','b.md'),('./a.md','a.md'),('../x/y','../x/y'),('a/b/../../../c','../c'),('/references/x.md','references/x.md'),('.',''),('a//b/','a/b'),('..','..'),('../../a','../../a')"


@query(f"WITH v(path, want) AS ({PATHS}) SELECT path, want AS normal FROM v")
def path_normalization(spark, sf_dir):
    return spark.sql(f"SELECT path FROM ({PATHS}) AS v(path, want)").select("path", C.normalize(F.col("path")).alias("normal"))


@query("SELECT base, CAST(count(*) AS BIGINT) AS n, count(*) = 1 AS unique_name FROM (SELECT string_split(path, '/')[-1] AS base FROM c) GROUP BY base")
def basename_counts(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy(C.basename(F.col("path")).alias("base")).agg(F.count("*").alias("n")).withColumn("unique_name", F.col("n") == 1)


RUNS = """SELECT DISTINCT skill_id, path, unnest(list_concat(regexp_extract_all(text, '[A-Za-z0-9._/-]+'), regexp_extract_all(text, '[)}]/([A-Za-z0-9._/-]+)', 1),
    regexp_extract_all(text, '\\$\\{?[A-Za-z_][A-Za-z0-9_]*/([A-Za-z0-9._/-]+)', 1))) AS form FROM c """


@query(f"SELECT skill_id, path, CAST(count(*) AS BIGINT) AS n_forms FROM ({RUNS}) GROUP BY skill_id, path")
def mention_tokens(spark, sf_dir):
    return references.mentions(corpus(spark, sf_dir)).groupBy("skill_id", "path").agg(F.count("*").alias("n_forms"))


EDGES = f"SELECT DISTINCT m.skill_id, m.path AS src, m.form AS dst FROM ({RUNS}) m JOIN c ON c.skill_id = m.skill_id AND c.path = m.form WHERE m.path <> m.form"


@query(EDGES)
def mention_edges(spark, sf_dir):
    found = corpus(spark, sf_dir)
    return references.edges(found, found)


@query(
    f"""SELECT c.skill_id, c.path FROM c WHERE c.path NOT IN ('SKILL.md', 'README.md', 'LICENSE') AND NOT EXISTS (
    WITH RECURSIVE e AS ({EDGES}), r(skill_id, path) AS (SELECT skill_id, path FROM c WHERE path = 'SKILL.md' UNION SELECT e.skill_id, e.dst FROM r JOIN e ON e.skill_id = r.skill_id AND e.src = r.path)
    SELECT 1 FROM r WHERE r.skill_id = c.skill_id AND r.path = c.path)"""
)
def unreachable_files(spark, sf_dir):
    found = corpus(spark, sf_dir)
    keep = table_store(spark)
    seen = references.reachable(keep(references.edges(found, found)), found.where("path = 'SKILL.md'"), keep)
    return found.where(~F.col("path").isin("SKILL.md", "README.md", "LICENSE")).join(seen, ["skill_id", "path"], "left_anti").select("skill_id", "path")


#: Skills whose files mention one another in every way that counts; one skill for each source, SKILL.md first.
MENTIONING = """
WITH d AS (
  SELECT doc_id, text, source AS skill_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
i AS (SELECT *, CAST(rn AS STRING) AS no FROM d),
p AS (
  SELECT *, CASE
      WHEN rn = 1 THEN 'SKILL.md' WHEN rn = 2 THEN 'scripts/__init__.py' WHEN rn = 3 THEN 'scripts/sub/__init__.py' WHEN rn = 4 THEN 'AGENTS.md'
      WHEN rn % 11 = 5 THEN concat('scripts/s', no, '.py') WHEN rn % 11 = 6 THEN concat('scripts/sub/t', no, '.py')
      WHEN rn % 11 = 7 THEN concat('references/r', no, '.md') WHEN rn % 11 = 8 THEN concat('lib/u', no, '.js')
      WHEN rn % 11 = 9 THEN concat('lib/v', CAST(rn % 4 AS STRING), CASE WHEN rn % 2 = 0 THEN '.js' ELSE '.ts' END, CASE WHEN rn > 40 THEN no ELSE '' END)
      WHEN rn % 11 = 10 THEN concat('assets/pool', CAST(rn % 4 AS STRING), '/f', no, '.bin') WHEN rn % 11 = 0 THEN concat('references/deep/d', no, '.md')
      WHEN rn % 11 = 1 THEN concat('same', no, '/guide', CAST(rn % 4 AS STRING), '.md') WHEN rn % 11 = 2 THEN concat('n', no, '.txt')
      WHEN rn % 11 = 3 THEN concat('lib/run', no, '/main.ts') ELSE concat('lib/run', CAST(rn - 1 AS STRING), '.js') END AS path
  FROM i),
n AS (SELECT *, lead(path) OVER (PARTITION BY skill_id ORDER BY rn) AS next, lead(path, 3) OVER (PARTITION BY skill_id ORDER BY rn) AS far FROM p),
m AS (
  SELECT *, CASE rn % 8 WHEN 0 THEN next WHEN 1 THEN concat('./', regexp_replace(next, '^.*/', '')) WHEN 2 THEN regexp_replace(next, '^.*/', '')
      WHEN 3 THEN replace(regexp_replace(next, '[.]py$', ''), '/', '.') WHEN 4 THEN concat('.', regexp_replace(regexp_replace(next, '^.*/', ''), '[.][a-z]+$', ''))
      WHEN 5 THEN regexp_replace(regexp_replace(next, '^.*/', ''), '[.][a-z]+$', '') WHEN 6 THEN regexp_replace(next, '[.](js|ts)$', '') ELSE concat('../', next) END AS one,
    CASE rn % 5 WHEN 0 THEN concat('/mnt/skills/', skill_id, '/', far, 'c') WHEN 1 THEN concat('../../', far) WHEN 2 THEN concat('assets/pool', CAST(rn % 4 AS STRING), '/')
      WHEN 3 THEN '../assets/pool3/' ELSE concat(chr(36), chr(123), 'ROOT', chr(125), '/', far) END AS two
  FROM n)
SELECT skill_id, path, CASE
    WHEN rn = 1 THEN concat('---', chr(10), 'name: ', skill_id, chr(10), 'hook: python "', chr(36), chr(123), 'DIR', chr(125), '/scripts/s5.py"', chr(10), '---', chr(10),
         'See [first](references/r7.md#top), [folder](./scripts/), [gone](references/gone.md), [shared](../shared/SKILL.md), [site](https://example.com/n13.txt) and `n13.txt`, ./assets/pool2', chr(10), text)
    WHEN rn % 7 <> 3 AND next IS NOT NULL AND far IS NOT NULL THEN concat(text, chr(10), 'Next: ', CASE WHEN rn % 3 = 0 THEN concat('`', one, '`') ELSE one END, ' and [x](', two, ')', chr(10))
    ELSE text END AS text
FROM m
"""


def mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(MENTIONING.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return found.select("skill_id", F.col("skill_id").alias("dir"), "path", F.encode("text", "UTF-8").alias("content"))


_SAME = "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))"
_NEAR = "array_to_string(list_concat(list_transform(range(len(a) - same), lambda i: '..'), b[same + 1:]), '/')"
_JS = "[.](js|mjs|cjs|jsx|ts|mts|cts|tsx)$"

#: Every spelling of every path against every document of its skill.
STATUSES = f"""WITH RECURSIVE c AS ({MENTIONING}),
docs AS (
  SELECT skill_id, path AS src, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS f, ends_with(lower(path), '.md') AS md, text FROM c WHERE path <> 'SKILL.md'
  UNION ALL SELECT skill_id, path, '', true, regexp_extract(text, '^---\\n.*?\\n---\\n(.*)$', 1, 's') FROM c WHERE path = 'SKILL.md'
  UNION ALL SELECT skill_id, path, '', false, regexp_extract(text, '^---\\n(.*?)\\n---\\n', 1, 's') FROM c WHERE path = 'SKILL.md'),
linked AS (SELECT *, CASE WHEN md THEN regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1) ELSE [] END AS links FROM docs),
tok AS (
  SELECT skill_id, src, f, md, text, links, CASE WHEN f = '' THEN [] ELSE string_split(f, '/') END AS a, list_distinct(list_concat(regexp_extract_all(text, '[A-Za-z0-9._/-]+'),
    regexp_extract_all(text, '[)}}]/([A-Za-z0-9._/-]+)', 1), regexp_extract_all(text, '\\$\\{{?[A-Za-z_][A-Za-z0-9_]*/([A-Za-z0-9._/-]+)', 1), links,
    CASE WHEN md THEN regexp_extract_all(text, '`([^`]+)`', 1) ELSE [] END)) AS t FROM linked),
spec AS (SELECT skill_id, path, regexp_replace(path, '{_JS}', '') AS form FROM c WHERE contains(path, '/') AND regexp_matches(path, '{_JS}')),
shaped AS (
  SELECT skill_id, path, path AS form FROM c
  UNION ALL SELECT s.skill_id, s.path, s.form FROM spec s WHERE NOT EXISTS (SELECT 1 FROM spec o WHERE o.skill_id = s.skill_id AND o.form = s.form AND o.path <> s.path) AND NOT EXISTS (SELECT 1 FROM c WHERE c.skill_id = s.skill_id AND c.path = s.form)),
base AS (SELECT skill_id, path, string_split(path, '/')[-1] AS form FROM c),
fixed AS (
  SELECT b.skill_id, b.path, b.form FROM base b WHERE b.path <> b.form AND contains(b.form, '.') AND NOT EXISTS (SELECT 1 FROM base o WHERE o.skill_id = b.skill_id AND o.form = b.form AND o.path <> b.path)
  UNION ALL SELECT skill_id, path, replace(left(path, len(path) - 3), '/', '.') FROM c WHERE contains(path, '/') AND ends_with(path, '.py')),
near AS (SELECT *, {_SAME} AS same FROM (SELECT tok.*, path AS dst, form, string_split(form, '/') AS b FROM tok JOIN shaped USING (skill_id))),
python AS (SELECT *, {_SAME} AS same FROM (SELECT tok.*, path AS dst, string_split(left(path, len(path) - 3), '/') AS b FROM tok JOIN (SELECT * FROM c WHERE ends_with(path, '.py')) USING (skill_id))),
module AS (SELECT *, len(a) - same AS ups, b[same + 1:] AS rest, CASE WHEN b[-1] = '__init__' THEN b[same + 1:len(b) - 1] ELSE b[same + 1:] END AS package FROM python),
e AS (
  SELECT skill_id, src, dst FROM (SELECT *, {_NEAR} AS n FROM near)
    WHERE list_contains(t, form) OR list_contains(t, n) OR NOT starts_with(n, '../') AND list_contains(t, concat('./', n)) OR n = '' AND regexp_matches(text, '(^|[^A-Za-z0-9._/-])($|[^A-Za-z0-9._/-])')
  UNION SELECT skill_id, src, path FROM tok JOIN fixed USING (skill_id) WHERE list_contains(t, form)
  UNION SELECT skill_id, src, dst FROM module WHERE list_contains(t, concat(repeat('.', CAST(ups + 1 AS BIGINT)), array_to_string(rest, '.'))) OR NOT md AND ups = 0 AND len(package) > 0 AND list_contains(t, array_to_string(package, '.'))
  UNION SELECT skill_id, src, path FROM tok JOIN c USING (skill_id) WHERE contains(tok.text, concat('/', skill_id, '/', path))
  UNION SELECT p.skill_id, p.path, q.path FROM c p JOIN c q ON p.skill_id = q.skill_id AND ends_with(p.path, '.py') AND ends_with(q.path, '/__init__.py') AND starts_with(p.path, left(q.path, len(q.path) - 11))),
r(skill_id, path) AS (SELECT skill_id, path FROM c WHERE path = 'SKILL.md' UNION SELECT e.skill_id, e.dst FROM r JOIN e ON e.skill_id = r.skill_id AND e.src = r.path),
dirs AS (SELECT DISTINCT skill_id, array_to_string(string_split(path, '/')[1:k], '/') AS form FROM (SELECT skill_id, path, unnest(range(1, len(string_split(path, '/')))) AS k FROM c)),
pools AS (
  SELECT DISTINCT skill_id, form FROM (SELECT *, {_NEAR} AS n FROM (SELECT *, {_SAME} AS same FROM (SELECT tok.*, form, string_split(form, '/') AS b FROM tok JOIN dirs USING (skill_id) SEMI JOIN r ON r.skill_id = tok.skill_id AND r.path = tok.src)))
    WHERE n <> '' AND (list_contains(t, concat(form, '/')) OR list_contains(t, concat(n, '/')) OR NOT starts_with(n, '../') AND list_contains(t, concat('./', n)))),
links AS (SELECT DISTINCT skill_id, target, regexp_replace(regexp_replace(regexp_replace(target, '#.*$', ''), '^[.]/', ''), '/$', '') AS normal FROM (SELECT skill_id, unnest(links) AS target FROM tok WHERE src = 'SKILL.md' AND md) WHERE NOT regexp_matches(target, '^[a-z]+:'))
SELECT skill_id, CASE WHEN starts_with(target, '../') THEN 'external' WHEN EXISTS (SELECT 1 FROM c WHERE c.skill_id = links.skill_id AND (c.path = normal OR starts_with(c.path, concat(normal, '/')))) THEN 'resolved' ELSE 'broken' END AS status, target AS path FROM links
UNION ALL SELECT skill_id, 'orphans', path FROM c WHERE path NOT IN ('SKILL.md', 'AGENTS.md') AND NOT EXISTS (SELECT 1 FROM r WHERE r.skill_id = c.skill_id AND r.path = c.path)
  AND NOT EXISTS (SELECT 1 FROM pools WHERE pools.skill_id = c.skill_id AND starts_with(c.path, concat(pools.form, '/')))"""


@query(STATUSES)
def reference_graph(spark, sf_dir):
    """All ways of mentioning; one row for each resolved, broken and external link and each orphan."""
    found = analyze(mentioning(spark, sf_dir), columns=("references",))
    parts = [found.select("skill_id", F.lit(k).alias("status"), F.explode(F.col("references")[k]).alias("path")) for k in ("resolved", "broken", "external", "orphans")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    """SELECT skill_id, concat('sha256:', sha256(string_agg(concat(path, chr(10), hash, chr(10)), '' ORDER BY path))) AS digest FROM (
    SELECT skill_id, path, CASE WHEN path = 'SKILL.md' THEN sha256(concat('{"description":"Synthetic skill ', skill_id, '","metadata":{},"name":"', skill_id, '"}', chr(10), substr(text, strpos(text, concat(chr(10), '---', chr(10))) + 5))) ELSE sha256(text) END AS hash FROM c) GROUP BY skill_id"""
)
def skill_digest(spark, sf_dir):
    own = skills(spark, sf_dir).select("skill_id", F.lit(K.SKILL_FILE).alias("path"), F.sha2(F.encode("hash_text", "UTF-8"), 256).alias("hash"))
    rest = manifest.entries(with_picks(spark, sf_dir)).where(F.col("path") != K.SKILL_FILE).select("skill_id", "path", F.col("sha256").alias("hash"))
    return manifest.digest(rest.unionByName(own))


@query("SELECT sha256(text) AS digest, CAST(min(doc_id) AS BIGINT) AS first_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY sha256(text)")
def digest_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


NAMES = "SELECT DISTINCT p_name AS name FROM part UNION SELECT replace(lower(p_name), ' ', '-') FROM part UNION SELECT unnest(['MySkill','my--skill','-a','a-','ok-1','default','demo',repeat('a',65)])"


@query(
    f"""SELECT name, length(name) > 64 AS too_long, NOT regexp_full_match(name, '[a-z0-9-]+') OR starts_with(name, '-') OR ends_with(name, '-') OR contains(name, '--') AS invalid,
    name IN ('default', 'example', 'demo', 'test', 'sample', 'template') AS reserved FROM ({NAMES})"""
)
def name_validation(spark, sf_dir):
    name = F.col("name")
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    more = spark.createDataFrame([(x,) for x in ("MySkill", "my--skill", "-a", "a-", "ok-1", "default", "demo", "a" * 65)], "name string")
    found = part.union(part.select(F.replace(F.lower("name"), F.lit(" "), F.lit("-")))).union(more).distinct()
    return found.select("name", (C.utf16_length(name) > K.NAME_LIMIT).alias("too_long"), (~C.valid_name(name)).alias("invalid"), name.isin(*K.RESERVED_NAMES).alias("reserved"))


@query("SELECT doc_id, length(text) > 1024 AS too_long, concat('description is ', CAST(length(text) AS VARCHAR), ' characters; maximum is 1024.') AS message FROM documents")
def description_limits(spark, sf_dir):
    size = C.utf16_length(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", (size > K.DESCRIPTION_LIMIT).alias("too_long"), F.concat(F.lit("description is "), size.cast("string"), F.lit(" characters; maximum is 1024.")).alias("message"))


#: One skill for each document, with everything that a diagnostic can complain of.
FAULTY = """
WITH d AS (SELECT doc_id, text, concat('s', CAST(doc_id AS STRING)) AS skill_id FROM documents),
f AS (
  SELECT *, doc_id % 13 = 0 AS bare, doc_id % 11 = 0 AS broken, doc_id % 3 = 0 AS licensed, doc_id % 2 = 0 AS readme, doc_id % 3 = 1 AS extra, doc_id % 97 = 0 AS big,
    CASE doc_id % 9 WHEN 1 THEN NULL WHEN 2 THEN repeat('a', 65) WHEN 3 THEN 'Bad--Name' WHEN 4 THEN 'demo' WHEN 5 THEN 'other' ELSE skill_id END AS name,
    CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN repeat('de', 600) ELSE concat('Skill of ', skill_id) END AS description,
    CASE WHEN doc_id % 5 = 0 THEN repeat('c', 501) END AS compatibility, CASE doc_id % 8 WHEN 0 THEN 'mit' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'my own' END AS license,
    CASE doc_id % 6 WHEN 0 THEN 'MIT License' WHEN 3 THEN concat('Apache License', chr(10), 'Version 2.0') ELSE 'Some license' END AS license_text,
    concat(chr(10), '# Title ##', chr(10), chr(10), CASE WHEN doc_id % 6 = 1 THEN 'Read `extra.txt`. ' ELSE '' END, CASE doc_id % 12 WHEN 0 THEN '[gone](gone.md) ' WHEN 1 THEN '[up](../x.md) ' ELSE '' END, 'See big.bin',
      chr(10), CASE WHEN doc_id % 10 = 0 THEN repeat('word ', 4000) ELSE '' END, CASE WHEN doc_id % 17 = 0 THEN repeat(chr(10), 600) ELSE '' END, text) AS body
  FROM d)
SELECT *, concat('---', chr(10), CASE WHEN broken THEN 'a: [' ELSE concat(
    CASE WHEN name IS NULL THEN '' ELSE concat('name: ', name, chr(10)) END, CASE WHEN description IS NULL THEN '' ELSE concat('description: ', description, chr(10)) END,
    CASE WHEN compatibility IS NULL THEN '' ELSE concat('compatibility: ', compatibility, chr(10)) END, CASE WHEN license IS NULL THEN '' ELSE concat('license: ', license, chr(10)) END,
    CASE doc_id % 4 WHEN 1 THEN concat('metadata:', chr(10), '  version: "1.0"', chr(10)) WHEN 2 THEN concat('metadata:', chr(10), '  version: 1.10', chr(10)) WHEN 3 THEN concat('version: "3"', chr(10), 'metadata:', chr(10), '  n: [1]', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 6 = 0 THEN concat('allowed-tools: Read Grep', chr(10)) ELSE '' END, 'own: true') END, chr(10), '---', chr(10), body) AS skill
FROM f
"""
FAULTY_FILES = """SELECT skill_id, 'SKILL.md' AS path, skill AS text FROM f WHERE NOT bare UNION ALL SELECT skill_id, 'README.md', 'Read me.' FROM f WHERE readme UNION ALL SELECT skill_id, 'LICENSE', license_text FROM f WHERE licensed
  UNION ALL SELECT skill_id, 'extra.txt', 'x' FROM f WHERE extra UNION ALL SELECT skill_id, 'big.bin', repeat('x', 1000001) FROM f WHERE big"""
LIMIT = 1_000_000


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(FAULTY.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    found = spark.sql(FAULTY_FILES.replace("FROM f", "FROM {f}"), f=made)
    found = found.select("skill_id", "path", F.encode("text", "UTF-8").alias("content")).unionByName(made.select("skill_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content")))
    return found.withColumn("dir", F.col("skill_id"))


REGISTERED = "VALUES " + ", ".join("('{}', '{}', '{}', {})".format(c, "warning" if c == "name-reserved" else s, m.replace("'", "''"), "NULL" if h is None else "'{}'".format(h.replace("'", "''"))) for c, s, m, h in K.REGISTRY)


def _rule(code: str, when: str, field: str = "NULL", message: str = "NULL") -> str:
    return f"SELECT skill_id, '{code}' AS code, {field} AS field, {message} AS message FROM f WHERE {when}"


_READ = "NOT bare AND NOT broken"
RULES = " UNION ALL ".join((
    _rule("no-skill-md", "bare"), _rule("name-missing", f"{_READ} AND name IS NULL", "'name'"),
    _rule("name-too-long", f"{_READ} AND length(name) > 64", "'name'", "concat('name is ', CAST(length(name) AS VARCHAR), ' characters; maximum is 64.')"),
    _rule("name-invalid", f"{_READ} AND name = 'Bad--Name'", "'name'", "'name must use only lowercase letters, digits, and hyphens; must not start or end with a hyphen or contain consecutive hyphens.'"),
    _rule("name-reserved", f"{_READ} AND name = 'demo'", "'name'", "'\"demo\" is a reserved skill name.'"),
    _rule("name-dir-mismatch", f"{_READ} AND name <> skill_id", "'name'", "concat('Frontmatter name \"', name, '\" does not match the skill folder name \"', skill_id, '\".')"),
    _rule("description-missing", f"{_READ} AND description IS NULL", "'description'"),
    _rule("description-too-long", f"{_READ} AND length(description) > 1024", "'description'", "concat('description is ', CAST(length(description) AS VARCHAR), ' characters; maximum is 1024.')"),
    _rule("compatibility-too-long", f"{_READ} AND compatibility IS NOT NULL", "'compatibility'", "'compatibility is 501 characters; maximum is 500.'"),
    _rule("metadata-non-string", f"{_READ} AND doc_id % 4 = 2", "'metadata.version'", "'metadata.version is not a string (got number); stringified to \"1.1\".'"),
    _rule("metadata-non-string", f"{_READ} AND doc_id % 4 = 3", "'metadata.n'", "'metadata.n is not a string (got array); stringified to \"[1]\".'"),
    _rule("version-missing", f"{_READ} AND doc_id % 4 = 0"), _rule("allowed-tools-experimental", f"{_READ} AND doc_id % 6 = 0", "'allowed-tools'"),
    _rule("body-too-long", "NOT bare AND ceil(length(body) / 4.0) > 4000", "NULL", "concat('SKILL.md body is approximately ', CAST(CAST(ceil(length(body) / 4.0) AS BIGINT) AS VARCHAR), ' tokens; recommended maximum is 4000.')"),
    _rule("body-too-many-lines", "NOT bare AND len(string_split(body, chr(10))) > 500", "NULL", "concat('SKILL.md body has ', CAST(len(string_split(body, chr(10))) AS VARCHAR), ' lines; recommended maximum is 500.')"),
    _rule("readme-missing", "NOT readme"), _rule("license-missing", f"NOT licensed AND NOT ({_READ} AND license IS NOT NULL)"), _rule("license-file-missing", f"NOT licensed AND {_READ} AND license IS NOT NULL", "'license'"),
    _rule("broken-ref", "NOT bare AND doc_id % 12 = 0", "'gone.md'"), _rule("external-ref", "NOT bare AND doc_id % 12 = 1", "'../x.md'"),
    _rule("orphan-file", "extra AND (bare OR doc_id % 6 <> 1)", "'extra.txt'"), _rule("orphan-file", "big AND bare", "'big.bin'"),
    _rule("file-too-large", "big", "'big.bin'", f"'big.bin: 1000001 bytes exceeds maxFileBytes ({LIMIT}).'"),
))
NOTED = f"""f AS ({FAULTY}), r(code, severity, message, hint) AS ({REGISTERED}),
noted AS (SELECT n.skill_id, r.code, r.severity, n.field, coalesce(n.message, r.message) AS message, r.hint FROM ({RULES}) n JOIN r USING (code))"""
FAULTY_OPTIONS = Options(max_file_bytes=LIMIT, rules={"name-reserved": "warning"})


@query(f"WITH {NOTED} SELECT *, CAST(row_number() OVER (PARTITION BY skill_id ORDER BY severity, code, coalesce(field, ''), message) - 1 AS INTEGER) AS pos FROM noted UNION ALL SELECT skill_id, 'frontmatter-parse', 'error', NULL, NULL, NULL, -1 FROM f WHERE broken AND NOT bare")
def diagnostics_all(spark, sf_dir):
    """Every rule on every document's skill, with order and hints; what a YAML parser says of an error is its own."""
    found = analyze(faulty(spark, sf_dir), FAULTY_OPTIONS, columns=("diagnostics",))
    failed = F.col("d.code") == "frontmatter-parse"
    found = found.select("skill_id", F.expr("exists(diagnostics, d -> d.code = 'frontmatter-parse')").alias("broken"), F.posexplode("diagnostics").alias("pos", "d"))
    # the parse error stands among the errors by its code; the others move up
    pos = F.when(failed, F.lit(-1)).otherwise(F.col("pos") - F.when(F.col("broken") & ((F.col("d.severity") != "error") | (F.col("d.code") > "frontmatter-parse")), 1).otherwise(0))
    own = lambda c: F.when(~failed, F.col(f"d.{c}")).alias(c)
    return found.select("skill_id", "d.code", "d.severity", own("field"), own("message"), own("hint"), pos.cast("int").alias("pos"))


@query(
    f"""WITH {NOTED}, k AS (SELECT *, {_READ} AS ok_read, CASE lower(license) WHEN 'mit' THEN 'MIT' WHEN 'apache-2.0' THEN 'Apache-2.0' END AS named, CASE license_text WHEN 'Some license' THEN NULL WHEN 'MIT License' THEN 'MIT' ELSE 'Apache-2.0' END AS headed FROM f)
    SELECT skill_id, skill_id AS dir, NOT EXISTS (SELECT 1 FROM noted WHERE noted.skill_id = k.skill_id AND severity = 'error') AND (bare OR NOT broken) AS ok,
      CASE WHEN ok_read THEN name END AS name, CASE WHEN ok_read THEN description END AS description, CASE WHEN ok_read THEN CASE doc_id % 4 WHEN 1 THEN '1.0' WHEN 2 THEN '1.1' WHEN 3 THEN '3' END END AS version,
      CASE WHEN ok_read AND doc_id % 6 = 0 THEN 'Read|Grep' END AS tools, CASE WHEN ok_read THEN CASE doc_id % 4 WHEN 1 THEN 'version=1.0' WHEN 2 THEN 'version=1.1' WHEN 3 THEN 'n=[1]' END END AS metadata,
      CASE WHEN ok_read THEN '{{"own":true}}' ELSE '{{}}' END AS extra,
      CASE WHEN ok_read THEN license END AS declared, CASE WHEN ok_read AND named IS NOT NULL THEN named WHEN licensed THEN headed END AS spdx, CASE WHEN licensed THEN 'LICENSE' END AS license_file,
      CASE WHEN ok_read AND named IS NOT NULL THEN 'frontmatter' WHEN licensed AND headed IS NOT NULL THEN 'file' END AS source, CASE WHEN readme THEN 'README.md' END AS readme,
      CAST(CASE WHEN ok_read THEN ceil((coalesce(length(name), 0) + coalesce(length(description), 0) + CASE WHEN name IS NOT NULL AND description IS NOT NULL THEN 1 ELSE 0 END) / 4.0) ELSE 0 END AS BIGINT) AS metadata_tokens,
      CAST(CASE WHEN bare THEN 0 ELSE ceil(length(body) / 4.0) END AS BIGINT) AS body_tokens, CASE WHEN NOT bare THEN CAST(len(string_split(body, chr(10))) AS BIGINT) END AS lines, CASE WHEN NOT bare THEN '1 Title' END AS heading,
      CAST((NOT bare)::INT + readme::INT + licensed::INT + extra::INT AS BIGINT) AS n_files
    FROM k"""
)
def final_records(spark, sf_dir):
    """The fields of each skill's record."""
    found = analyze(faulty(spark, sf_dir), FAULTY_OPTIONS)
    fm = lambda c: F.col(f"frontmatter.{c}")
    metadata = F.array_join(F.transform(F.map_entries(fm("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return found.select(
        "skill_id", "dir", "ok", fm("name"), fm("description"), fm("version"), F.array_join(fm("allowedTools"), "|").alias("tools"), metadata.alias("metadata"), fm("extra"), F.col("license.declared"), F.col("license.spdx"),
        F.col("license.file").alias("license_file"), F.col("license.source"), F.col("readme.path").alias("readme"), F.col("tokens.metadata").alias("metadata_tokens"), F.col("tokens.body").alias("body_tokens"), F.col("body.lines"),
        F.expr("concat(body.headings[0].depth, ' ', body.headings[0].text)").alias("heading"), F.size("files").cast("long").alias("n_files"),
    )


#: Paths in the order of their UTF-16 code units, the last of which are ignored by default.
ORDERED = ("A.md", "SKILL.md", "a/b.md", "a0.md", "é.md", "日.md", "\U0001f600.md", "Ａ.md")
IGNORED = (".git/config", "a/node_modules/x.js", "b/.DS_Store", "yarn.lock")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(ORDERED)) + ") AS v(pos, path)")
def path_order(spark, sf_dir):
    """Default ignore list, and files and orphans in path order."""
    found = spark.createDataFrame([("s", p, bytearray(b"x")) for p in ORDERED[::-1] + IGNORED], "skill_id string, path string, content binary").withColumn("dir", F.lit(None).cast("string"))
    found = analyze(found, columns=("files", "references"))
    same = F.expr("filter(transform(files, f -> f.path), p -> p <> 'SKILL.md') = references.orphans")
    return found.where(same).select(F.posexplode(F.transform("files", lambda f: f["path"])).alias("pos", "path"))


CODES = ("name-reserved", "license-missing", "broken-ref", "name-missing", "orphan-file")
RAW = "SELECT doc_id, CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END AS code, source AS skill_id FROM documents"


def severities(spark, sf_dir, rules) -> DataFrame:
    raw = spark.sql(RAW.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return diagnostics.finalize(raw.select("skill_id", "code", F.col("doc_id").cast("string").alias("field"), F.lit(None).cast("string").alias("message")), rules)


DEFAULTS = "VALUES " + ", ".join("('{}', '{}', '{}')".format(c, s, m.replace("'", "''")) for c, s, m, _ in K.REGISTRY)


@query(f"WITH r(code, severity, message) AS ({DEFAULTS}) SELECT skill_id, code, severity, CAST(doc_id AS VARCHAR) AS field, message FROM ({RAW}) JOIN r USING (code) WHERE severity <> 'off'")
def diagnostics_default(spark, sf_dir):
    return severities(spark, sf_dir, {}).select("skill_id", "code", "severity", "field", "message")


@query(
    f"""WITH r(code, severity, message) AS ({DEFAULTS}), o AS (SELECT skill_id, code, CASE code WHEN 'name-reserved' THEN 'error' WHEN 'broken-ref' THEN 'off' ELSE severity END AS severity FROM ({RAW}) JOIN r USING (code))
    SELECT skill_id, code, severity, CAST(count(*) AS BIGINT) AS n FROM o WHERE severity <> 'off' GROUP BY ALL"""
)
def diagnostics_rules(spark, sf_dir):
    return severities(spark, sf_dir, {"name-reserved": "error", "broken-ref": "off", "no-such-code": "error"}).groupBy("skill_id", "code", "severity").agg(F.count("*").alias("n"))


@query(f"WITH r(code, severity, message) AS ({DEFAULTS}) SELECT skill_id, NOT bool_or(severity = 'error') AS ok, CAST(count(*) AS BIGINT) AS n FROM ({RAW}) JOIN r USING (code) WHERE severity <> 'off' GROUP BY skill_id")
def ok_flag(spark, sf_dir):
    return diagnostics.gathered(severities(spark, sf_dir, {})).select("skill_id", "ok", F.size("diagnostics").cast("long").alias("n"))


@query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN concat(CAST(n AS VARCHAR), ' B') ELSE concat(CAST(t // 10 AS VARCHAR), CASE WHEN t % 10 = 0 THEN '' ELSE concat('.', CAST(t % 10 AS VARCHAR)) END, CASE WHEN n < 1048576 THEN ' KB' ELSE ' MB' END) END AS size
    FROM (SELECT doc_id, n_chars AS n, CAST(floor(n_chars / CASE WHEN n_chars < 1048576 THEN 1024.0 ELSE 1048576.0 END * 10 + 0.5) AS BIGINT) AS t FROM documents)"""
)
def format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.format_bytes(F.col("n_chars")).alias("size"))


TOOLS = (("Read, Grep, Glob", "Read|Grep|Glob"), ("Bash(git add:*) Read", "Bash(git add:*)|Read"), ("a,b c", "a|b|c"), ("x)y z", "x)y|z"), ("  ", ""))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TOOLS) + ") AS v(tools, parts)")
def allowed_tools(spark, sf_dir):
    found = spark.createDataFrame([(a, f'---\nname: x\nallowed-tools: "{a}"\n---\n') for a, _ in TOOLS], "skill_id string, text string").withColumn("dir", F.lit(None).cast("string"))
    return frontmatter.parsed(found).select(F.col("skill_id").alias("tools"), F.coalesce(F.array_join("allowedTools", "|"), F.lit("")).alias("parts"))


YAML = (("a: 014", '{"a":14}'), ("a: yes", '{"a":"yes"}'), ("a: 1.10", '{"a":1.1}'), ("b: [1e21, 1e-7, -0]\na: ~", '{"a":null,"b":[1e+21,1e-7,0]}'), ("a: 0o14", '{"a":12}'), ("d: 2024-01-02", '{"d":"2024-01-02"}'), ("a: 0x1F", '{"a":31}'), ("~: v", '{"":"v"}'),
    ("a:\tb\tc", '{"a":"b\\tc"}'), ("a: [.inf, -.inf, .nan]", '{"a":[null,null,null]}'), ("a: " + "1" * 310, '{"a":null}'), ("a: !!set {x}", '{"a":{}}'), ("10: x\n9: y", '{"10":"x","9":"y"}'), ("a: &x\n  b: *x", '{"a":{"b":null}}'), ("? [a, 1]\n: v", '{"[ a, 1 ]":"v"}'), ("<<: x", '{"<<":"x"}'))


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(a.replace("\n", "|"), b) for a, b in YAML) + ") AS v(yaml, json)")
def yaml_canonical_json(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            yield pdf.assign(json=[yaml12.canonical_json(yaml12.load(y.replace("|", "\n"))) for y in pdf["yaml"]])

    return spark.createDataFrame([(a.replace("\n", "|"),) for a, _ in YAML], "yaml string").mapInPandas(run, "yaml string, json string")


@query()
def analyze_json(spark, sf_dir):
    """The whole output document of each skill."""
    found = analyze(files(spark, sf_dir), Options(rules={"name-reserved": "warning"}))
    to_json = F.udf(render.to_json, "string")
    return found.select("skill_id", "ok", "digest", to_json(F.struct(*found.columns)).alias("json"))


@query("SELECT skill_id, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS size FROM c GROUP BY skill_id")
def analyze_summary(spark, sf_dir):
    found = analyze(files(spark, sf_dir), columns=("files", "size"))
    return found.select("skill_id", F.size("files").cast("long").alias("n_files"), F.col("size.total").alias("size"))
