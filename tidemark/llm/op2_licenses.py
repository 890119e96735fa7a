"""Licences of files: sparse TF-IDF cosine of lines and licence files to templates, then inheritance from the
nearest ancestor directory. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Short headers of common licences, by identifier.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
#: Least cosine, and names of files whose whole text is compared besides its lines.
THRESHOLD, LICENCE_FILE = 0.75, "^(?i)(licen[cs]e|copying|unlicense)"
WORDS = "[a-z0-9]+"


def words_of(text: str) -> list[str]:
    import re

    return re.findall(WORDS, text.lower())


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _distinct(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"))


def idf_table(files: DataFrame, terms: list[str]) -> tuple[dict[str, float], int]:
    """Inverse document frequency of the templates' terms over all texts, and the number of texts. As many
    rows as the templates have words reach the driver."""
    common = F.array_intersect(_distinct(F.col("text")), F.array(*map(F.lit, terms)))
    seen = files.select(F.explode(F.concat(common, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    df = {r.term: r["count"] for r in seen}
    n = df.get("", 0)
    return {t: log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in terms}, n


def idf_of_all(files: DataFrame, n: int) -> DataFrame:
    """term and idf of every word of the n texts."""
    df = files.select(F.explode(_distinct(F.col("text"))).alias("term")).groupBy("term").count()
    return df.select("term", (F.log(F.lit(float(n + 1)) / (F.col("count") + 1)) + 1).alias("idf"))


def anchors(weights: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a text that reaches the threshold with some template has one at least: by the
    Cauchy-Schwarz bound a template's lightest terms can be left out while their norm stays below the threshold."""
    out = set()
    for vector in weights.values():
        total, rest = sqrt(sum(w * w for w in vector.values())), 0.0
        for term, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            rest += w * w
            if sqrt(rest) >= threshold * total - 1e-9:
                out.add(term)
    return sorted(out)


def _may_reach(text: Column, idf: dict[str, float], unit: dict[str, dict[str, float]], threshold: float) -> Column:
    """If the text's cosine with some template can reach the threshold. Exact as a filter: no word's idf is under 1 and
    no count's square under the count, so the words' squared weights, 1 for those of no template, sum to the squared norm at most."""
    table = lambda values: F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))
    total = lambda terms, values: F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.coalesce(table(values)[t], F.lit(0.0)))
    squares = {t: w * w for t, w in idf.items()}
    dots = [{t: idf[t] * w for t, w in v.items()} for v in unit.values()]
    most = lambda terms: F.array_max(F.array(*(total(terms, d) for d in dots)))
    reach = lambda tokens, terms: most(terms) >= (threshold - 1e-5) * F.sqrt(total(terms, squares) + F.size(tokens) - F.size(terms))
    return F.exists(F.array(_tokens(text)), lambda tokens: F.exists(F.array(F.filter(tokens, lambda t: t.isin(*idf))), lambda terms: reach(tokens, terms)))  # each made once


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, text) to path, own_license, own_score, license, inherited_from.

    A file's own licence is the template nearest to one of its lines, or to its whole text where its name is that of a
    licence file; ties go to the first identifier. A file without one has that of the nearest directory above it, its own first, in
    which a licence file has one (the best score, then the first path); inherited_from is that directory.

    Null and empty texts have no licence of their own; a null path is no part of a tree and inherits nothing. Repeated
    paths are rows each, and have the best licence of any. An empty table gives no rows; other columns aren't read.
    A word's document frequency is counted over all texts, whether or not a template has it.
    Equal lines (by digest) are scored once, and only digests meet their words. All lines are read; only those without any word
    that a match must have, or that can't reach the threshold whatever their other words weigh, are left.
    """
    templates = TEMPLATES if templates is None else templates
    if not templates:
        raise ValueError("no templates")
    spark = files.sparkSession
    counts = {k: {w: words_of(v).count(w) for w in words_of(v)} for k, v in templates.items()}
    idf, n = idf_table(files, sorted({w for v in counts.values() for w in v}))
    weights = {k: {w: c * idf[w] for w, c in v.items()} for k, v in counts.items()}
    names = sorted(weights)
    unit = {k: {w: x / sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for k, v in weights.items()}
    must = anchors(weights, threshold)
    hit = lambda text: F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in must], F.lit(False)))  # noqa: E731  lowered once
    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    is_licence = F.coalesce(F.element_at(F.split("path", "/"), -1), F.lit("")).rlike(LICENCE_FILE)
    found = rows.where(hit(F.col("text"))).withColumn("part", F.explode(F.concat(F.split("text", "\n"), F.when(is_licence, F.array("text")).otherwise(F.array().cast("array<string>")))))
    found = written(found.where(hit(F.col("part"))).where(_may_reach(F.col("part"), idf, unit, threshold)).select("path", F.md5("part").alias("key"), "part"), "lines")
    columns = [f"w{i}" for i in range(len(names))]
    table = [(term, *(unit[k].get(term, 0.0) for k in names)) for term in sorted(idf)]
    units = F.broadcast(spark.createDataFrame(table, ", ".join(["term string", *(f"{c} double" for c in columns)])))
    word = found.select("key", "part").dropDuplicates(["key"]).select("key", F.explode(_tokens(F.col("part"))).alias("term")).groupBy("key", "term").count()
    word = word.join(idf_of_all(files, n), "term").join(units, "term", "left").withColumn("x", F.col("count") * F.col("idf"))
    sums = word.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *(F.sum(F.col("x") * F.coalesce(c, F.lit(0.0))).alias(c) for c in columns))
    cosines = F.array(*(F.struct((-F.round(F.col(c) / F.col("norm"), 6)).alias("s"), F.lit(k).alias("license")) for c, k in zip(columns, names, strict=True)))
    best = sums.select("key", F.array_min(cosines).alias("m")).where(F.col("m.s") <= -threshold).select("key", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))
    best = written(best, "scores")
    own = _best(found.select("path", "key").join(best, "key"), "path").select(F.col("path").alias("p"), F.col("license").alias("own_license"), F.col("score").alias("own_score"))
    own = written(own, "own")  # read three times below
    full = rows.select("path").join(own, F.col("path").eqNullSafe(F.col("p")), "left").drop("p")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    full = full.withColumn("dir", F.when(F.col("path").isNotNull(), folder))
    granted = full.where(F.col("own_license").isNotNull() & is_licence).groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("g"))
    granted = granted.select(F.col("dir").alias("above"), F.col("g.own_license").alias("license"))
    steps = F.split("dir", "/")
    ancestor = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("n"), F.concat_ws("/", F.slice(steps, F.lit(1), n)).alias("above")))
    dirs = full.where("own_license is null and dir is not null").select("dir").distinct().select("dir", F.explode(ancestor).alias("a")).select("dir", "a.*")
    near = dirs.join(granted, "above").groupBy("dir").agg(F.max_by(F.struct("license", "above"), "n").alias("near"))
    done = full.join(near, "dir", "left")
    return done.select(
        "path", "own_license", "own_score", F.coalesce("own_license", "near.license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.above")).alias("inherited_from"),
    )


def _best(scores: DataFrame, key: str) -> DataFrame:
    """The license and score of the highest score of each key, ties to the first license."""
    least = scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m"))
    return least.select(key, F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))


def files_of(documents: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language, 64 ids to a folder; every eighth id is named as a licence file."""
    name = F.concat(F.when(F.col("doc_id") % 8 == 0, "LICENSE-").otherwise("file-"), F.col("doc_id").cast("string"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/b"), F.floor(F.col("doc_id") / 64).cast("string"), F.lit("/"), name)
    return documents.select(path.alias("path"), "text")


def _oracle() -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    return f"""
WITH t(license, text) AS (VALUES {values}),
tw AS (SELECT license, term, count(*) AS c FROM (SELECT license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM t) GROUP BY 1, 2),
f AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') || '/b' || (doc_id // 64) AS dir, CASE WHEN doc_id % 8 = 0 THEN 'LICENSE-' ELSE 'file-' END || doc_id AS name, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM f),
dw AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT dir, name, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM f) GROUP BY 1),
idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM tw UNION SELECT term FROM dw) LEFT JOIN dw USING (term), n),
tv AS (SELECT license, term, c * idf / sqrt(sum((c * idf) ** 2) OVER (PARTITION BY license)) AS weight FROM tw JOIN idf USING (term)),
p AS (SELECT dir, name, unnest(string_split(text, chr(10))) AS part FROM f UNION ALL SELECT dir, name, text FROM f WHERE name LIKE 'LICENSE%'),
w AS (SELECT part, term, count(*) AS c FROM (SELECT part, unnest(regexp_extract_all(lower(part), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT part FROM p)) GROUP BY 1, 2),
x AS (SELECT part, term, c * idf AS x FROM w JOIN idf USING (term)),
norm AS (SELECT part, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1),
sc AS (SELECT part, license, round(sum(x * weight) / any_value(norm), 6) AS score FROM x JOIN tv USING (term) JOIN norm USING (part) GROUP BY 1, 2),
own AS (SELECT dir, name, license, score FROM p JOIN sc USING (part) WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY dir, name ORDER BY score DESC, license) = 1),
g AS (SELECT dir AS above, license FROM own WHERE name LIKE 'LICENSE%' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, name) = 1),
a AS (SELECT DISTINCT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM f),
near AS (SELECT dir, license, above FROM (SELECT dir, n, array_to_string(string_split(dir, '/')[1:n], '/') AS above FROM a) JOIN g USING (above)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC) = 1)
SELECT f.dir || '/' || f.name AS path, own.license AS own_license, own.score AS own_score, coalesce(own.license, near.license) AS license,
  CASE WHEN own.license IS NULL THEN near.above END AS inherited_from
FROM f LEFT JOIN own USING (dir, name) LEFT JOIN near ON near.dir = f.dir
"""


ORACLE = _oracle()
