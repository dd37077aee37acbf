"""SQL equivalents of the core queries, over the same whole tables."""

from __future__ import annotations

from skein.functions import vocabulary as V
from skein.operators.entities import seed_keys


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    """A SQL list for IN."""
    return ", ".join(map(quoted, values))


def cased(values: dict[str, str], x: str) -> str:
    """A SQL CASE that looks ``x`` up."""
    return f"CASE {x} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in values.items()) + " END"


def norm(x: str) -> str:
    """Normalised name."""
    for a, b in V.GREEK.items():
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    x = f"replace(replace(replace(lower({x}), '’', ''''), '`', ''''), '_', ' ')"
    strip = " || ".join(["' .,;:()[]{}\"'''", "chr(9)", "chr(10)", "chr(13)"])
    return f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g'), {strip}), '^(the|an?)\\s+', '')"


def key(x: str) -> str:
    """Match key of a normalised name."""
    return f"trim(regexp_replace(replace({x}, '''', ''), '[^a-z0-9]+', ' ', 'g'))"


def relation(x: str) -> str:
    """Normalised relation."""
    r = f"upper(trim(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]+', '_', 'g'), '_'))"
    return f"CASE WHEN {r} IN ({listed(V.RELATION_TYPES)}) THEN {r} ELSE coalesce({cased(V.RELATION_ALIASES, r)}, CASE WHEN length({r}) > 40 THEN 'ASSOCIATED_WITH' ELSE {r} END) END"


def kind(x: str) -> str:
    """Normalised entity type."""
    t = f"upper(substr(trim({x}), 1, 1)) || lower(substr(trim({x}), 2))"
    return f"CASE WHEN {t} IN ({listed(V.ENTITY_TYPES)}) THEN {t} ELSE 'Other' END"


def year(x: str) -> str:
    """Cleaned year."""
    y = f"try_cast(substr(cast({x} AS VARCHAR), 1, 4) AS INTEGER)"
    return f"CASE WHEN {y} > 1800 AND {y} < 2200 THEN {y} END"


def strength(c: str, s: str) -> str:
    """Edge strength."""
    return f"greatest({c}, 0.001) * (1 + ln(greatest({s}, 1)))"


def cost(c: str, s: str) -> str:
    """Edge cost."""
    return f"(-ln(1 - (1 - least(greatest({c}, 0.001), 0.999)) / (1 + ln(greatest({s}, 1)))) + {V.HOP_PENALTY})"


_SEEDS = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in seed_keys().items())
NAMED = f"""
forms AS (SELECT form, {norm('form')} AS norm FROM (SELECT subject AS form FROM triplets UNION SELECT object FROM triplets) WHERE form IS NOT NULL),
keyed AS (SELECT form, norm, {key('norm')} AS key FROM forms WHERE norm <> ''),
elist AS (SELECT name, {key(norm('form'))} AS key, rk FROM (SELECT name, name AS form, 0 AS rk FROM entities UNION ALL SELECT name, unnest(aliases), 1 FROM entities)),
kidx AS (SELECT key, name FROM (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY rk, name) AS r FROM elist WHERE key <> '') WHERE r = 1),
seeds AS (SELECT * FROM (VALUES {_SEEDS}) t(key, seed)),
named AS (SELECT f.form, f.norm, coalesce(k.name, k2.name, s.seed, f.norm) AS name,
  CASE WHEN coalesce(k.name, k2.name, s.seed) IS NULL THEN 'new' ELSE 'exact' END AS how
  FROM keyed f LEFT JOIN kidx k ON f.key = k.key LEFT JOIN seeds s ON f.key = s.key LEFT JOIN kidx k2 ON {key('s.seed')} = k2.key)"""
ROWS = f"""WITH {NAMED},
rows_ AS (SELECT a.name AS subject, b.name AS object, a.norm AS subject_raw, b.norm AS object_raw, {relation('t.relation')} AS relation,
  least(greatest(coalesce(t.confidence, 0.5), 0), 1) AS confidence, {kind('t.subject_type')} AS subject_type, {kind('t.object_type')} AS object_type,
  t.paper_id, t.seq, {year('t.year')} AS year, t.provenance_snippet
  FROM triplets t JOIN named a ON t.subject = a.form JOIN named b ON t.object = b.form
  WHERE a.name <> b.name AND {relation('t.relation')} <> ''),
evid AS (SELECT subject AS source, relation AS type, object AS target, paper_id, min(seq) AS seq, arg_min(confidence, (seq, confidence)) AS confidence, min(year) AS year
  FROM rows_ GROUP BY 1, 2, 3, 4),
rel AS (SELECT source, type, target, list(paper_id ORDER BY seq, paper_id) AS papers, count(*)::INTEGER AS support, sum(confidence) AS conf_sum, min(year) AS first_year, sum(confidence) / count(*) AS confidence
  FROM evid GROUP BY 1, 2, 3),
edge AS (SELECT source, type, target, papers, first_year, coalesce(nullif(confidence, 0), 0.5) AS confidence, coalesce(nullif(support, 0), 1) AS support, least(source, target) AS u, greatest(source, target) AS v
  FROM rel WHERE source <> target),
meas AS (SELECT *, {strength('confidence', 'support')} AS strength, {cost('confidence', 'support')} AS cost FROM edge),
pairw AS (SELECT u, v, sum(strength) AS w, min(cost) AS cost FROM meas GROUP BY 1, 2),
adj AS (SELECT u AS src, v AS dst, w FROM pairw UNION ALL SELECT v, u, w FROM pairw),
deg AS (SELECT src AS name, count(*) AS degree FROM adj GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY strength DESC, source, type, target) AS r FROM meas) WHERE r = 1),
men AS (SELECT subject AS entity, paper_id FROM rows_ UNION SELECT object, paper_id FROM rows_),
aa AS (SELECT x.src AS source, y.dst AS target, 1 - exp(-sum(1 / ln(d.degree + 1))) AS score FROM adj x JOIN deg d ON x.dst = d.name AND d.degree >= 2 JOIN adj y ON y.src = x.dst
  WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.src = x.src AND z.dst = y.dst) GROUP BY 1, 2)
"""


def pagerank_sql(seed: str, steps: int, damping: float = V.DAMPING) -> str:
    """Personalised PageRank as a chain of ``steps`` tables."""
    sql = ROWS + f""",
nodes AS MATERIALIZED (SELECT DISTINCT src AS name FROM adj UNION SELECT name FROM entities), e0 AS MATERIALIZED (SELECT name, CASE WHEN name = {quoted(seed)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e FROM nodes),
tot AS MATERIALIZED (SELECT src, sum(w) AS t FROM adj GROUP BY 1), mv AS MATERIALIZED (SELECT a.src, a.dst, a.w / t.t AS m FROM adj a JOIN tot t ON a.src = t.src),
p0 AS MATERIALIZED (SELECT name, e AS p FROM e0)"""
    for i in range(steps):
        sql += f""",
p{i + 1} AS MATERIALIZED (SELECT e.name, {1 - damping} * e.e + {damping} * (coalesce(g.g, 0) + (SELECT coalesce(sum(p), 0) FROM p{i} WHERE name NOT IN (SELECT src FROM tot)) * e.e) AS p
  FROM e0 e LEFT JOIN (SELECT mv.dst, sum(mv.m * p.p) AS g FROM mv JOIN p{i} p ON mv.src = p.name GROUP BY 1) g ON e.name = g.dst)"""
    return sql + f" SELECT name, round(p, 8) AS ppr FROM p{steps}"
