"""p5: values typed freely, mapped to a reference list. SQL only.

Partition-based pigeonhole join on the different typed values of a domain:

* every reference string (name or alias, squeezed to letters and digits) is cut into k + 1 segments,
  where k, the edits allowed, follows from its length; if a typed value is within k edits, one segment
  must stand in it unchanged, shifted by at most k places;
* segments and the positional substrings of the typed values meet in an equality join;
* survivors are verified with the built-in levenshtein, and the nearest reference wins;
* word order and shortened words ("stre. processing", "sys admin") have their own equality keys;
* words that accompany a value ("senior", "needed asap") are not listed: a word that stands before, or after,
  the exact or shortened names of LEAST_NAMES or more different entries of its domain is taken off on that side;
* what is still open is joined once more by its runs of words, under half the edits;
* what no join reaches is reported through an anti-join, with ref_id 0.

Only different values are compared, so hot values cost nothing there; their rows meet the finished
mapping in one join, whose skew adaptive execution splits.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import written

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h",
    "ӏ": "l", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "α": "a", "ε": "e", "ρ": "p", "ο": "o", "ι": "i",
    "ν": "v", "υ": "u", "χ": "x", "τ": "t", "κ": "k", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s", "ꜱ": "s",
}
#: Accented Latin letters, by Unicode's own decomposition.
LOOKALIKES |= {c: d[0] for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}
LOOKALIKE_FROM, LOOKALIKE_TO = "".join(LOOKALIKES), "".join(LOOKALIKES.values())

DOMAINS = ("skill", "title", "city")
#: Different reference entries whose exact names a word must stand beside, on one side, to count as accompanying.
LEAST_NAMES = 3
#: Runs of words that are looked at have this many words more than the longest name at most (longer ones are no typing of it).
MORE_WORDS = 1

#: Edits allowed by length of the squeezed reference: under 4 characters none, 4 one, under 8 two, under 11 three, else four (a swap of two letters counts two).
EDITS = ((4, 0), (5, 1), (8, 2), (11, 3))
MOST_EDITS = 4


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _edits(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} < {n} THEN {k}" for n, k in EDITS) + f" ELSE {MOST_EDITS} END"


def _squeezed(x: str) -> str:
    return f"regexp_replace({x}, '[^a-z0-9+#]', '')"


def _words(x: str) -> str:
    return f"array_sort(filter(split(regexp_replace({x}, '[^a-z0-9+#/]+', ' '), ' '), w -> w NOT IN ('', 'of', 'the')))"


def _keys(x: str) -> str:
    """The words of a value, digits alike, without signs around them; a word of signs only is ''."""
    return f"transform(filter(split({x}, ' +'), w -> w <> ''), w -> regexp_replace(regexp_replace(w, '[0-9]+', '0'), '^[^a-z0-9+#]+|[^a-z0-9+#]+$', ''))"


def _bare_words(x: str) -> str:
    return f"filter(split(regexp_replace(replace({x}, '/', ''), '[^a-z0-9+#]+', ' '), ' '), w -> w <> '')"


#: Whether a typed word f is the word r, or shortened from it: its letters in order, the first the same, two or more left out.
_SHORT = "(w.f = w.r OR (length(w.f) > 1 AND length(w.r) - length(w.f) > 1 AND w.r RLIKE concat('^', regexp_replace(w.f, '(.)', '$1.*'))))"


def _first(x: str) -> str:
    return f"array_join(transform({x}, w -> substring(w, 1, 1)), ' ')"


def _shortened(f: str, r: str) -> tuple[str, str]:
    """An equality key of two arrays of words, and the test that each word of f is, or shortens, that of r."""
    return f"size({f}) = size({r}) AND {_first(f)} = {_first(r)}", f"forall(zip_with({f}, {r}, (a, b) -> named_struct('f', a, 'r', b)), w -> {_SHORT})"


def _clean() -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower(v), {_quoted(LOOKALIKE_FROM)}, {_quoted(LOOKALIKE_TO)}), '\\\\([^)]*\\\\)|\\\\[[^\\\\]]*\\\\]|[\"“”_]', ' '), '(?U)\\\\s+', ' '))"


PLAIN_SQL = f"""
SELECT domain, v, n, h, filter(split(n, ' +'), w -> w <> '') AS t, {_keys('n')} AS k
FROM (SELECT domain, v, n, split(n, CASE WHEN domain = 'city' THEN ' - | – | / |, ' ELSE ' - | – ' END)[0] AS h FROM (SELECT domain, v, {_clean()} AS n FROM {{typed}}))
"""

RUNS_SQL = f"""
SELECT p.domain, p.v, size(p.k) AS m, i, c, array_join(slice(p.k, i, c), ' ') AS x, array_join(slice(p.t, i, c), ' ') AS x0
FROM {{plain}} p JOIN (SELECT domain, max(size({_keys('name')})) + {MORE_WORDS} AS most FROM {{ref}} GROUP BY domain) r ON p.domain = r.domain
LATERAL VIEW explode(CASE WHEN size(p.k) > 0 THEN sequence(1, size(p.k)) ELSE array() END) e AS i
LATERAL VIEW explode(sequence(1, least(r.most, size(p.k) - i + 1))) g AS c
"""

NAMED_SQL = f"""
SELECT r.domain, r.v, r.m, r.i, r.c, f.ref_id, true AS exact, length({_squeezed('r.v')}) - length({_squeezed('r.x')}) AS rest FROM {{runs}} r JOIN (SELECT DISTINCT domain, ref_id, array_join({_keys('name')}, ' ') AS x FROM {{ref}}) f ON r.domain = f.domain AND r.x = f.x
UNION ALL
SELECT r.domain, r.v, r.m, r.i, r.c, f.ref_id, false, length({_squeezed('r.v')}) - length({_squeezed('r.x0')}) FROM (SELECT *, {_bare_words('x0')} AS ws FROM {{runs}} WHERE c > 1 AND x0 LIKE '%.%') r JOIN {{ref}} f ON r.domain = f.domain AND {_shortened('r.ws', 'f.ws')[0]} WHERE {_shortened('r.ws', 'f.ws')[1]}
"""

BESIDE_SQL = f"""
SELECT domain, side, w FROM (
  SELECT n.domain, n.ref_id, 'before' AS side, explode(slice(p.k, 1, n.i - 1)) AS w FROM {{named}} n JOIN {{plain}} p ON n.domain = p.domain AND n.v = p.v WHERE n.i > 1
  UNION ALL
  SELECT n.domain, n.ref_id, 'after' AS side, explode(slice(p.k, n.i + n.c, n.m)) AS w FROM {{named}} n JOIN {{plain}} p ON n.domain = p.domain AND n.v = p.v WHERE n.i + n.c <= n.m
) WHERE w <> '' GROUP BY domain, side, w HAVING count(DISTINCT ref_id) >= {LEAST_NAMES}
"""

STRIPPED_SQL = """
SELECT p.domain, p.v, coalesce(array_join(slice(p.t, first, greatest(0, last - first + 1)), ' '), '') AS x
FROM (
  SELECT w.domain, w.v, min(CASE WHEN w.w <> '' AND b.w IS NULL THEN w.i END) + 1 AS first, max(CASE WHEN w.w <> '' AND a.w IS NULL THEN w.i END) + 1 AS last
  FROM (SELECT domain, v, posexplode(k) AS (i, w) FROM {plain}) w
  LEFT JOIN {beside} b ON b.side = 'before' AND w.domain = b.domain AND w.w = b.w
  LEFT JOIN {beside} a ON a.side = 'after' AND w.domain = a.domain AND w.w = a.w
  GROUP BY w.domain, w.v
) s JOIN {plain} p ON s.domain = p.domain AND s.v = p.v WHERE first IS NOT NULL AND last IS NOT NULL
"""

FORMS_SQL = f"""
SELECT domain, v, min(rank) AS rank, x, {_squeezed('x')} AS s FROM (
  SELECT domain, v, 1 AS rank, x FROM {{stripped}} UNION ALL SELECT domain, v, 1, x FROM {{heads}} UNION ALL SELECT domain, v, 2, n FROM {{plain}}
) WHERE {_squeezed('x')} <> '' GROUP BY domain, v, x
"""


REFERENCE_SQL = f"""
SELECT DISTINCT domain, ref_id, name, {_squeezed('name')} AS s, {_edits(f"length({_squeezed('name')})")} AS k,
       array_join({_words('name')}, ' ') AS w, {_bare_words('name')} AS ws
FROM (SELECT domain, ref_id, translate(lower(trim(name)), {_quoted(LOOKALIKE_FROM)}, {_quoted(LOOKALIKE_TO)}) AS name FROM {{reference}} WHERE name IS NOT NULL AND trim(name) <> '')
"""

NEAR_SQL = f"""
WITH pieces AS (
  SELECT domain, ref_id, s, k, i, p, length(s) AS len, substring(s, p, q) AS part, q
  FROM (
    SELECT domain, ref_id, s, k, i, CAST(floor(i * length(s) / (k + 1)) AS INT) + 1 AS p,
           CAST(floor((i + 1) * length(s) / (k + 1)) AS INT) - CAST(floor(i * length(s) / (k + 1)) AS INT) AS q
    FROM {{ref}} LATERAL VIEW explode(sequence(0, k)) e AS i
  )
),
shapes AS (SELECT DISTINCT domain, len, k, i, p, q FROM pieces),
probes AS (
  SELECT domain, len, i, q, n, greatest(1, p - k) AS lo, least(n - q + 1, p + k) AS hi
  FROM shapes LATERAL VIEW explode(sequence(greatest(1, len - k), len + k)) e AS n
),
typed AS (SELECT DISTINCT domain, s, length(s) AS n FROM {{forms}}),
grams AS (
  SELECT DISTINCT f.domain, f.s, b.len, b.i, substring(f.s, at, b.q) AS part
  FROM typed f JOIN probes b ON f.domain = b.domain AND f.n = b.n
  LATERAL VIEW explode(CASE WHEN b.hi >= b.lo THEN sequence(b.lo, b.hi) ELSE array() END) e AS at
)
SELECT domain, s, ref_id, min(d) AS d FROM (
  SELECT c.domain, c.s, c.ref_id, c.k, levenshtein(c.s, c.r, c.k) AS d
  FROM (
    SELECT DISTINCT g.domain, g.s, p.ref_id, p.s AS r, p.k
    FROM grams g JOIN pieces p ON g.domain = p.domain AND g.len = p.len AND g.i = p.i AND g.part = p.part
  ) c
) WHERE d >= 0 AND d <= k GROUP BY domain, s, ref_id
"""

CHOICE_SQL = f"""
WITH scored AS (
  SELECT f.domain, f.v, n.ref_id, f.rank, CAST(n.d AS DOUBLE) AS d FROM {{forms}} f JOIN {{near}} n ON f.domain = n.domain AND f.s = n.s
  UNION ALL
  SELECT f.domain, f.v, r.ref_id, f.rank, 0.5D FROM (SELECT *, array_join({_words('x')}, ' ') AS w FROM {{forms}}) f JOIN {{ref}} r ON f.domain = r.domain AND f.w = r.w
  UNION ALL
  SELECT f.domain, f.v, r.ref_id, f.rank, CASE WHEN f.x LIKE '%.%' THEN 0.75D ELSE 1.5D END
  FROM (SELECT domain, v, rank, x, {_bare_words('x')} AS ws FROM {{forms}}) f JOIN {{ref}} r ON f.domain = r.domain AND {_shortened('f.ws', 'r.ws')[0]}
  WHERE (size(f.ws) > 1 OR f.x LIKE '___%.') AND {_shortened('f.ws', 'r.ws')[1]}
  UNION ALL
  SELECT domain, v, ref_id, 3, CAST(rest AS DOUBLE) + CASE WHEN exact THEN 0D ELSE 0.75D END FROM {{named}}
)
SELECT domain, v, b.ref_id, b.d AS edits
FROM (SELECT domain, v, min(named_struct('d', d, 'rank', rank, 'ref_id', ref_id)) AS b FROM scored GROUP BY domain, v)
"""

OPEN_SQL = f"""
SELECT r.domain, r.v, r.m, r.i, r.c, {_squeezed('r.x0')} AS s FROM {{runs}} r LEFT ANTI JOIN {{mapped}} m ON r.domain = m.domain AND r.v = m.v
WHERE r.c < r.m AND length({_squeezed('r.x0')}) >= 5
"""

LATE_SQL = """
SELECT domain, v, b.ref_id, b.d AS edits, b.m, b.i, b.c FROM (
  SELECT f.domain, f.v, min(named_struct('d', CAST(n.d AS DOUBLE), 'l', -length(f.s), 'ref_id', n.ref_id, 'm', f.m, 'i', f.i, 'c', f.c)) AS b
  FROM {open} f JOIN {near} n ON f.domain = n.domain AND f.s = n.s GROUP BY f.domain, f.v
)
"""

ROWS_SQL = """
SELECT a.* FROM (SELECT *, regexp_replace(lower(item), '(?U)^\\\\s+|\\\\s+$', '') AS v FROM {values}) a
LEFT ANTI JOIN (SELECT domain, lower(trim(name)) AS name FROM {reference} WHERE NOT alias) r ON a.domain = r.domain AND a.v = r.name
WHERE a.v <> ''
"""


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Mapping of typed values to reference entries.

    values: rows with domain ('skill', 'title' or 'city') and item; further columns pass through.
    reference: domain, ref_id int, name string, alias boolean.
    Rows whose item, trimmed and in any casing, is itself a name are left out (aliases are mapped);
    so are null and blank items. Every other row comes out with ref_id, 0 where nothing was meant.
    Repeated rows stay; an empty table gives an empty result; of equally near entries the smallest
    ref_id wins. What is read more than once is written once: the rows, and the small tables of
    different values.
    """
    spark = values.sparkSession
    rows = written(spark.sql(ROWS_SQL, values=values, reference=reference), "typed")
    typed = written(spark.sql("SELECT DISTINCT domain, v FROM {rows}", rows=rows), "values")
    ref = written(spark.sql(REFERENCE_SQL, reference=reference), "reference")
    plain = written(spark.sql(PLAIN_SQL, typed=typed), "plain")
    runs = written(spark.sql(RUNS_SQL, plain=plain, ref=ref), "runs")
    named = written(spark.sql(NAMED_SQL, runs=runs, ref=ref), "named")
    beside = written(spark.sql(BESIDE_SQL, named=named, plain=plain), "beside")
    heads = written(spark.sql(f"SELECT domain, v, trim(h) AS n, filter(split(h, ' +'), w -> w <> '') AS t, {_keys('h')} AS k FROM {{plain}} WHERE h <> n", plain=plain), "heads")

    def choose(plain: DataFrame, heads: DataFrame, named: DataFrame, beside: DataFrame) -> DataFrame:
        forms = written(spark.sql(FORMS_SQL, plain=plain, stripped=spark.sql(STRIPPED_SQL, plain=plain, beside=beside), heads=spark.sql(STRIPPED_SQL, plain=heads, beside=beside)), "forms")
        near = written(spark.sql(NEAR_SQL, ref=ref, forms=forms), "near")
        return written(spark.sql(CHOICE_SQL, ref=ref, forms=forms, near=near, named=named), "mapped")

    first = choose(plain, heads, named, beside)
    # open values: the runs of words near a name tell further accompanying words, which are taken off before the second choice
    runs = written(spark.sql(OPEN_SQL, runs=runs, mapped=first), "open")
    half = ref.withColumn("k", F.floor(F.col("k") / 2).cast("int"))
    late = written(spark.sql(LATE_SQL, open=runs, near=spark.sql(NEAR_SQL, ref=half, forms=runs)), "late")
    every = named.select("domain", "v", "m", "i", "c", "ref_id").unionByName(late.select("domain", "v", "m", "i", "c", "ref_id"))
    beside = written(spark.sql(BESIDE_SQL, named=every, plain=plain), "beside")
    left = lambda df: df.join(first.select("domain", "v"), ["domain", "v"], "left_anti")
    second = choose(left(plain), left(heads), left(named), beside)
    chosen = first.unionByName(second)
    mapped = chosen.unionByName(late.select("domain", "v", "ref_id", "edits").join(second.select("domain", "v"), ["domain", "v"], "left_anti"))
    return spark.sql(
        "SELECT r.*, m.ref_id FROM {rows} r JOIN (SELECT domain, v, ref_id FROM {mapped} UNION ALL "
        "SELECT t.domain, t.v, 0 FROM {typed} t LEFT ANTI JOIN {mapped} x ON t.domain = x.domain AND t.v = x.v) m ON r.domain = m.domain AND r.v = m.v",
        rows=rows, mapped=mapped, typed=typed,
    ).drop("v")
