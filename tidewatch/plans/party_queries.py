"""Entity resolution over accounts derived from the part table.

Four neighbouring parts play four accounts of one owner: two exact copies, one
with a longer name, one with a partly different address.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.text import char_ngrams
from tidewatch.operators import components, entity as er
from tidewatch.plans.registry import query
from tidewatch.session import cut_lineage, shuffled
from tidewatch.sources.model import table


def accounts(spark, sf):
    key = F.col("p_partkey")
    owner = F.md5(F.floor(key / 4).cast("string"))
    name = F.concat(F.upper(F.substring(owner, 1, 8)), F.lit(" "), F.substring(owner, 9, 8))
    address = F.substring(owner, 17, 12)
    df = table(spark, sf, "part").select(
        key.alias("p_partkey"),
        F.when(key % 4 == 2, F.concat(name, F.lit("st"))).otherwise(name).alias("name"),
        F.when(key % 4 == 3, F.concat(F.substring(address, 1, 8), F.lit("zzzz"))).otherwise(address).alias("address"),
        F.col("p_brand").alias("country"),
    )
    return er.normalise(df, "p_partkey", "name", "address", "country")


ACCOUNTS_SQL = """
owner AS (SELECT p_partkey AS id, md5((p_partkey // 4)::VARCHAR) AS o, p_brand AS ct FROM part),
accounts AS (SELECT id, upper(o[1:8]) || ' ' || o[9:16] || CASE id % 4 WHEN 2 THEN 'st' ELSE '' END AS nm,
  lower(o[1:16][1:8] || ' ' || o[9:16]) || CASE id % 4 WHEN 2 THEN 'st' ELSE '' END AS normalized_name,
  CASE id % 4 WHEN 3 THEN o[17:24] || 'zzzz' ELSE o[17:28] END AS ad, ct FROM owner)"""

PAIRS_SQL = ACCOUNTS_SQL + """,
names AS (SELECT DISTINCT normalized_name AS t, list_distinct(list_transform(range(1, length(normalized_name) + 2), lambda i: substr(' ' || normalized_name || ' ', i, 2))) AS g FROM accounts),
grams AS (SELECT t, unnest(g) AS gram FROM names),
shared AS (SELECT a.t AS text_a, b.t AS text_b, count(*) AS n FROM grams a JOIN grams b USING (gram) WHERE a.t < b.t GROUP BY 1, 2),
name_pairs AS (SELECT text_a, text_b, round(n / (len(a.g) + len(b.g) - n), 6) AS jaccard FROM shared JOIN names a ON a.t = text_a JOIN names b ON b.t = text_b
  WHERE n / (len(a.g) + len(b.g) - n) >= 0.8),
people AS (SELECT normalized_name, ad, min(id) AS profile, count(*) AS copies FROM accounts GROUP BY 1, 2),
near AS (SELECT text_a AS x, text_b AS y FROM name_pairs UNION ALL SELECT text_b, text_a FROM name_pairs UNION ALL SELECT t, t FROM names),
scored AS (SELECT p.profile AS a, q.profile AS b, round(0.5 * (1 - levenshtein(p.normalized_name, q.normalized_name) / greatest(length(p.normalized_name), length(q.normalized_name)))
    + 0.5 * (1 - levenshtein(p.ad, q.ad) / greatest(length(p.ad), length(q.ad))), 6) AS score
  FROM people p JOIN near ON x = p.normalized_name JOIN people q ON q.normalized_name = y AND p.profile < q.profile),
pairs AS (SELECT * FROM scored WHERE score >= 0.8)"""


@query("SELECT id, nm AS NM, ad AS AD, normalized_name, ct AS CT FROM accounts", ctes=ACCOUNTS_SQL)
def normalised_accounts(spark, sf):
    return accounts(spark, sf).drop("effective_date")


@query("SELECT normalized_name, ad AS AD, profile, copies FROM people", ctes=PAIRS_SQL)
def account_profiles(spark, sf):
    return er.profiles(accounts(spark, sf))


@query("""
SELECT p_partkey, gram FROM (SELECT p_partkey, unnest(list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr(' ' || p_name || ' ', i, 2)))) AS gram FROM part)""")
def character_ngrams(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(char_ngrams(F.col("p_name"))).alias("gram"))


def agreement(exact, equal, components):
    """Whether a share of equal components fits the exact similarity.

    It may be as far off as a binomial of so many components is with probability e^-32 by Chernoff's bound,
    which unlike standard deviations holds for small similarities too. At 0 and 1 it has to be exact.
    """
    part = lambda q, p: F.when(q == 0, 0.0).when(p > 0, q * F.ln(q / p)).otherwise(float("inf"))
    return components * (part(equal, exact) + part(1 - equal, 1 - exact)) <= 32


# Signatures of neighbouring accounts' names agree about as often as the exact Jaccard similarity says; names are
# equal, similar or unlike.
@query("""
SELECT a.id, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 6) AS jaccard, true AS agrees, 64 AS components
FROM accounts a JOIN accounts b ON b.id = a.id + 1 JOIN names x ON x.t = a.normalized_name JOIN names y ON y.t = b.normalized_name""", ctes=PAIRS_SQL)
def minhash_signatures(spark, sf):
    # names meet first: grams and signatures are many times their size, and are neither broadcast nor shuffled
    names = accounts(spark, sf).select("id", F.col("normalized_name").alias("x"))
    pairs = names.join(shuffled(names.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))), "id")
    pairs = pairs.select("id", char_ngrams(F.col("x")).alias("g"), char_ngrams(F.col("y")).alias("h"))
    pairs = pairs.select("*", er.minhash(F.col("g")).alias("s"), er.minhash(F.col("h")).alias("t"))
    shared = F.size(F.array_intersect("g", "h"))
    exact = shared / (F.size("g") + F.size("h") - shared)
    equal = F.size(F.filter(F.zip_with("s", "t", lambda x, y: x == y), lambda z: z)) / F.size("s")
    near = agreement(exact, equal, F.size("s"))
    return pairs.select("id", F.round(exact, 6).alias("jaccard"), near.alias("agrees"), F.size("s").alias("components"))


@query("SELECT * FROM name_pairs", ctes=PAIRS_SQL)
def similar_name_pairs(spark, sf):
    return er.lsh_pairs(accounts(spark, sf), "normalized_name", block_size=200)


def _pairs(spark, sf, **kw):
    people = er.profiles(accounts(spark, sf))
    return er.score_pairs(people, er.lsh_pairs(people, "normalized_name"), **kw), people


@query("SELECT a, b, score FROM pairs", ctes=PAIRS_SQL)
def scored_account_pairs(spark, sf):
    return _pairs(spark, sf)[0]


@query("""
SELECT p.profile AS a, q.profile AS b, round(0.5 * (1 - damerau_levenshtein(p.normalized_name, q.normalized_name) / greatest(length(p.normalized_name), length(q.normalized_name)))
    + 0.5 * (1 - damerau_levenshtein(p.ad, q.ad) / greatest(length(p.ad), length(q.ad))), 6) AS score
FROM people p JOIN near ON x = p.normalized_name JOIN people q ON q.normalized_name = y AND p.profile < q.profile
WHERE round(0.5 * (1 - damerau_levenshtein(p.normalized_name, q.normalized_name) / greatest(length(p.normalized_name), length(q.normalized_name)))
    + 0.5 * (1 - damerau_levenshtein(p.ad, q.ad) / greatest(length(p.ad), length(q.ad))), 6) >= 0.8""", ctes=PAIRS_SQL)
def scored_account_pairs_with_swaps(spark, sf):
    return _pairs(spark, sf, transpositions=True)[0]


# Orders hang on customers, and customers on their nation and segment: a component for each of the latter.
@query("""
WITH c AS (SELECT c_custkey, 1000000000 + c_nationkey * 1000 + ascii(c_mktsegment) AS grp, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer)
SELECT c_custkey AS node, component FROM c UNION ALL SELECT DISTINCT grp, component FROM c
UNION ALL SELECT 2000000000 + o_orderkey, component FROM orders JOIN c ON c_custkey = o_custkey""")
def connected_accounts(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("a"), (F.lit(1000000000) + F.col("c_nationkey") * 1000 + F.ascii("c_mktsegment")).cast("long").alias("b")
    )
    orders = table(spark, sf, "orders").select((F.lit(2000000000).cast("long") + F.col("o_orderkey")).alias("a"), F.col("o_custkey").alias("b"))
    return components.connected_components(customers.unionByName(orders), "a", "b")


# Each owner's profiles p (two copies), p+2 and p+3: p-p+2 and p-p+3 may match.
@query("""
SELECT source, mean_score, clique_size FROM (
  SELECT m.source, m.mean_score, sum(m.copies) OVER (PARTITION BY m.clique) AS clique_size FROM (
    SELECT unnest(CASE WHEN profile % 4 = 0 AND copies = 2 THEN [profile, profile + 1] ELSE [profile] END) AS source, 1 AS copies, mean_score, clique FROM (
      SELECT profile, copies, arg_max(clique, (mean_score, clique)) AS clique, max(mean_score) AS mean_score FROM (
        SELECT p.profile, p.copies, e.clique, round((p.copies - 1 + q.copies * e.score) / (p.copies + q.copies - 1), 6) AS mean_score
        FROM (SELECT a AS me, b AS other, score, a || '|' || b AS clique FROM pairs UNION ALL SELECT b, a, score, a || '|' || b FROM pairs) e
        JOIN people p ON p.profile = e.me JOIN people q ON q.profile = e.other
        UNION ALL SELECT profile, copies, 'alone-' || profile, 1.0 FROM people WHERE copies > 1 AND profile NOT IN (SELECT a FROM pairs UNION ALL SELECT b FROM pairs))
      GROUP BY 1, 2)) m)
WHERE clique_size > 1""", ctes=PAIRS_SQL)
def resolved_parties(spark, sf):
    # here no three profiles match each other, so every clique is a pair
    return er.resolve(accounts(spark, sf)).select("source", "mean_score", "clique_size")


# Every part matches the next two: one component of all parts whose cliques overlap.
@query("""
WITH e AS (SELECT a.p_partkey AS a, b.p_partkey AS b, 0.8 + ((a.p_partkey * 7 + b.p_partkey) % 20) / 100 AS s
  FROM part a JOIN part b ON b.p_partkey - a.p_partkey IN (1, 2)),
sym AS (SELECT a, b, s FROM e UNION ALL SELECT b, a, s FROM e),
three AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b),
cliques AS (SELECT [i, j, k] AS members FROM three WHERE NOT EXISTS (
    SELECT 1 FROM sym p JOIN sym q ON q.b = p.b JOIN sym r ON r.b = p.b WHERE p.a = i AND q.a = j AND r.a = k)
  UNION ALL SELECT [a, b] FROM e WHERE NOT EXISTS (SELECT 1 FROM sym p JOIN sym q ON q.b = p.b WHERE p.a = e.a AND q.a = e.b)),
means AS (SELECT m AS profile, sha256(array_to_string(members, '|')) AS clique, round(avg(s), 6) AS mean_score
  FROM (SELECT unnest(members) AS m, members FROM cliques) JOIN sym ON sym.a = m AND list_contains(members, sym.b) GROUP BY m, members),
best AS (SELECT profile, max(mean_score) AS mean_score, arg_max(clique, (mean_score, clique)) AS clique FROM means GROUP BY 1)
SELECT profile, clique, mean_score, n AS clique_size FROM best JOIN (SELECT clique, count(*) AS n FROM best GROUP BY 1 HAVING count(*) > 1) USING (clique)""")
def overlapping_cliques(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("profile"), F.lit(1).cast("long").alias("copies"))
    near = part.select(F.col("profile").alias("a"), F.explode(F.array(F.col("profile") + 1, F.col("profile") + 2)).alias("b"))
    pairs = near.join(part.select(F.col("profile").alias("b")), "b").select("a", "b", (0.8 + (F.col("a") * 7 + F.col("b")) % 20 / 100).alias("score"))
    return er.cluster(pairs, part).select("profile", "clique", "mean_score", "clique_size")


_ASSIGNED_SQL = PAIRS_SQL + """,
existing AS (SELECT profile AS id, 'P' || (profile // 8) AS party FROM people WHERE profile % 4 <> 0)"""


@query("""
SELECT id, arg_max(party, (s, party)) AS party, max(s) AS mean_score FROM (
  SELECT e.id, x.party, round(avg(e.score), 6) AS s FROM (SELECT a AS id, b AS other, score FROM pairs UNION ALL SELECT b, a, score FROM pairs) e
  JOIN existing x ON x.id = e.other WHERE e.id NOT IN (SELECT id FROM existing) GROUP BY 1, 2) GROUP BY 1""", ctes=_ASSIGNED_SQL)
def incremental_matches(spark, sf):
    pairs, people = _pairs(spark, sf)
    existing = people.filter(F.col("profile") % 4 != 0).select(
        F.col("profile").alias("id"), F.concat(F.lit("P"), F.floor(F.col("profile") / 8)).alias("party")
    )
    return er.attach_new(pairs, existing)


_BATCH_SQL = PAIRS_SQL + """,
known AS (SELECT profile AS id, 'P' || (profile // 8) AS party FROM people WHERE profile % 4 = 3),
sides AS (SELECT a AS id, b AS other, score FROM pairs UNION ALL SELECT b, a, score FROM pairs),
first AS (SELECT id, arg_max(party, (s, party)) AS party, max(s) AS mean_score FROM (
  SELECT e.id, k.party, round(avg(e.score), 6) AS s FROM sides e JOIN known k ON k.id = e.other WHERE e.id % 4 <> 3 GROUP BY 1, 2) GROUP BY 1),
known_1 AS (SELECT * FROM known UNION ALL SELECT id, party FROM first WHERE id % 4 = 0),
batch_2 AS (SELECT id, arg_max(party, (s, party)) AS party, max(s) AS mean_score FROM (
  SELECT e.id, k.party, round(avg(e.score), 6) AS s FROM sides e JOIN known_1 k ON k.id = e.other WHERE e.id % 4 = 2 GROUP BY 1, 2) GROUP BY 1),
known_2 AS (SELECT * FROM known UNION ALL SELECT id, party FROM first),
second AS (SELECT id, arg_max(party, (s, party)) AS party, max(s) AS mean_score FROM (
  SELECT e.id, k.party, round(avg(e.score), 6) AS s FROM sides e JOIN known_2 k ON k.id = e.other WHERE e.id NOT IN (SELECT id FROM known_2) GROUP BY 1, 2) GROUP BY 1)"""


# Of each owner's profiles p, p + 2 and p + 3 only the last has a party; p + 2 matches p alone. Once p and
# p + 2 come in two batches, and once in one, where p + 2 follows p in a second round.
@query("""
SELECT 'batch 1' AS batch, id, party, mean_score, 1 AS round FROM first WHERE id % 4 = 0
UNION ALL SELECT 'batch 2', id, party, mean_score, 1 FROM batch_2
UNION ALL SELECT 'both', id, party, mean_score, 1 FROM first
UNION ALL SELECT 'both', id, party, mean_score, 2 FROM second""", ctes=_BATCH_SQL)
def matched_batches(spark, sf):
    people = cut_lineage(er.profiles(accounts(spark, sf)))
    kind = F.col("profile") % 4
    known = people.filter(kind == 3)
    parties = known.select(F.col("profile").alias("id"), F.concat(F.lit("P"), F.floor(F.col("profile") / 8)).alias("party"))
    state = er.Matched(known, er.name_bands(known, "normalized_name"), parties)
    one, after = er.match_batch(state, people.filter(kind == 0))
    two, _ = er.match_batch(after, people.filter(kind == 2))
    both, _ = er.match_batch(state, people.filter(kind != 3))
    out = None
    for name, rows in (("batch 1", one), ("batch 2", two), ("both", both)):
        rows = rows.withColumn("batch", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT a, b, CASE WHEN score >= 0.85 THEN 3 ELSE 0 END::BIGINT AS state, 0::BIGINT AS state_off FROM pairs", ctes=PAIRS_SQL)
def match_states(spark, sf):
    score = F.col("score")
    return _pairs(spark, sf)[0].select("a", "b", er.match_state(score, 0.85).alias("state"), er.match_state(score, -1).alias("state_off"))


_STATES_SQL = """
edges AS (SELECT p_partkey AS id, 'P' || (p_partkey // 3) AS party, round(p_size / 50.0, 2)::DOUBLE AS sc, p_partkey % 4 AS st FROM part),
kept AS (SELECT * FROM edges WHERE st IN (1, 3)),
parties AS (SELECT * FROM kept WHERE party IN (SELECT party FROM kept GROUP BY 1 HAVING count(*) > 1))"""


def _parties(spark, sf):
    key = F.col("p_partkey")
    part = table(spark, sf, "part")
    data = F.to_json(F.struct(F.round(F.col("p_size") / 50.0, 2).alias("SC"), (key % 4).cast("string").alias("ST")))
    edges = part.select(key.alias("id"), F.concat(F.lit("P"), F.floor(key / 3)).alias("source_node"), data.alias("data"))
    nodes = part.select(key.alias("id"), F.to_json(F.struct(F.col("p_name").alias("NM"), F.col("p_brand").alias("AD"))).alias("data"))
    return er.load_parties(edges, nodes)


@query("""
SELECT id AS account_id, party AS party_id, sc AS mean_score, st::INT AS "ST", p_name AS "NM", p_brand AS "AD" FROM parties JOIN part ON p_partkey = id""", ctes=_STATES_SQL)
def loaded_parties(spark, sf):
    return _parties(spark, sf)


@query("""
SELECT party AS party_id, 0::BIGINT AS part, '[' || string_agg('{"account_id": "' || id || '"}', ',' ORDER BY id::VARCHAR) || ']' AS party_accounts FROM parties GROUP BY 1""", ctes=_STATES_SQL)
def party_member_lists(spark, sf):
    return er.party_members(_parties(spark, sf))


_RESULT_SQL = """
result AS (SELECT 'P' || (p_partkey // 3) AS clique, p_partkey AS source, round(p_size / 50.0, 2)::DOUBLE AS mean_score FROM part)"""


def _result(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.floor(key / 3)).alias("clique"), key.alias("source"), F.round(F.col("p_size") / 50.0, 2).alias("mean_score")
    )


def _party_graph(spark, sf):
    existing = table(spark, sf, "part").select(F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 9)).alias("id"))
    return er.party_graph(_result(spark, sf), existing, F.lit("2001-01-01").cast("date"))


@query("""
SELECT DISTINCT clique AS id, clique AS "PI", 1::BIGINT AS "CN", DATE '2001-01-01' AS effective_date FROM result WHERE clique NOT IN (SELECT 'P' || (p_partkey // 9) FROM part)""", ctes=_RESULT_SQL)
def party_nodes(spark, sf):
    return _party_graph(spark, sf)[0].select("id", "PI", "CN", "effective_date")


@query("""
SELECT source AS id, clique AS source_node, source AS target_node, mean_score AS "SC", CASE WHEN mean_score >= 0.8 THEN 3 ELSE 0 END::BIGINT AS "ST", DATE '2001-01-01' AS effective_date FROM result""", ctes=_RESULT_SQL)
def party_account_edges(spark, sf):
    return _party_graph(spark, sf)[1]
