"""DuckDB SQL for the registered queries; it takes nothing from the operators that it checks."""

from __future__ import annotations

#: The fields, and how often each agrees among matches and among others.
FIELDS = ("first_name", "middle_name", "last_name", "dob", "dod", "email", "phone_number", "birth_city")
M = ("0.9", "0.8", "0.95", "0.98", "0.98", "0.99", "0.99", "0.9")
U = ("0.1", "0.2", "0.005", "0.005", "0.005", "0.3", "0.05", "0.05")

_NODES = """
nodes AS (
  SELECT 'r' || r_regionkey AS node_id, r_regionkey::BIGINT AS node_ord, 'region' AS kind, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 1000000000000 + n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 2000000000000 + s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 3000000000000 + c_custkey, 'customer', c_name FROM customer)"""
_EDGES = """
edges AS (
  SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, true AS directed, 'located_in' AS type FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, false, 'based_in' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, true, 'resident_of' FROM customer
  UNION ALL SELECT DISTINCT 'c' || o_custkey, 's' || l_suppkey, false, 'trade' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ADJ = """
adj AS (
  SELECT source AS node_id, target AS nbr, 'outgoing' AS direction FROM edges WHERE directed
  UNION SELECT target, source, 'incoming' FROM edges WHERE directed
  UNION SELECT source, target, 'undirected' FROM edges WHERE NOT directed
  UNION SELECT target, source, 'undirected' FROM edges WHERE NOT directed),
nbrs AS (SELECT DISTINCT node_id, nbr FROM adj),
degrees AS (SELECT n.node_id, n.node_ord, count(b.nbr) AS degree FROM nodes n LEFT JOIN nbrs b USING (node_id) GROUP BY 1, 2)"""
GRAPH = f"{_NODES},{_EDGES},{_ADJ}"
_SUBJECTS = """
keyed AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 IN (1, 2) THEN c_custkey - c_custkey % 4 ELSE c_custkey END AS b FROM customer),
subjects AS (
  SELECT k AS subject_ord, 's' || k AS uuid, 'b' || b AS base_id,
    CASE WHEN k % 4 = 1 AND b % 3 = 0 THEN substr(c_mktsegment, 1, length(c_mktsegment) - 1) ELSE c_mktsegment END AS first_name,
    CASE WHEN b % 10 < 7 THEN chr((65 + b % 26)::INT) END AS middle_name, n_name AS last_name,
    strftime(DATE '1950-01-01' + ((b * 37) % 20000 + CASE WHEN k % 4 = 2 AND b % 5 = 0 THEN 1 ELSE 0 END)::INT, '%Y-%m-%d') AS dob,
    CASE WHEN b % 17 = 0 THEN '2010-01-01' END AS dod,
    lower(c_mktsegment || '.' || n_name) || '@' || ['gmail.com', 'aol.com', 'proton.me'][((CASE WHEN k % 4 = 1 THEN k ELSE b END) % 3 + 1)::INT] AS email,
    CASE WHEN b % 10 <> 9 AND k % 4 <> 2 THEN '555' || lpad(((b * 7919) % 10000000)::VARCHAR, 7, '0') END AS phone_number,
    CASE WHEN b % 5 <> 4 THEN r_name END AS birth_city
  FROM keyed JOIN customer ON c_custkey = b JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def _odds() -> str:
    out = "1e-7::DOUBLE"
    for f, m, u in zip(FIELDS, M, U, strict=True):
        a, b = (f"lower(translate({s}.{f}, {_PUNCT}, ''))" for s in "lr")
        out += f" + CASE WHEN l.{f} IS NULL OR r.{f} IS NULL THEN 0 WHEN {a} = {b} THEN ln({m}::DOUBLE / {u}::DOUBLE) ELSE ln((1 - {m}::DOUBLE) / (1 - {u}::DOUBLE)) END"
    return out


_FS = f"""WITH {_SUBJECTS}, scored AS (
  SELECT l.subject_ord AS i, r.subject_ord AS j, l.uuid AS a, r.uuid AS b, exp({_odds()}) AS e, l.base_id = r.base_id AS same, r.base_id AS base
  FROM subjects l JOIN subjects r ON l.subject_ord < r.subject_ord), fs AS (
SELECT (i * (2 * (SELECT count(*) FROM customer) - i - 1) // 2 + (j - i - 1) + 1)::INT AS "Row", a AS "Subject1_UUID", b AS "Subject2_UUID",
  floor(e / (1 + e) * 10000) / 10000.0 AS "Felligi_Sunter_Similarity_Score", CASE WHEN same THEN 'Yes' ELSE 'No' END AS "Match",
  CASE WHEN same THEN base END AS "Base_ID" FROM scored)"""
FS = _FS + " SELECT * FROM fs"
FS_ACCURACY = _FS + """ SELECT round(avg(CASE WHEN ("Felligi_Sunter_Similarity_Score" > 0.9) = ("Match" = 'Yes') THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(CASE WHEN "Felligi_Sunter_Similarity_Score" > 0.9 THEN 1.0 ELSE 0.0 END) FILTER ("Match" = 'Yes'), 6) AS recall, count(*) AS pairs FROM fs"""
RESULTS = _FS + """ SELECT "Row", "Subject1_UUID", "Subject2_UUID", 0.5::DOUBLE AS "Gradient_Boosted_Score", NULL::DOUBLE AS "Transformer_Similarity_Score",
  "Felligi_Sunter_Similarity_Score", NULL::DOUBLE AS "Composite_Score", "Match", "Base_ID" FROM fs"""
ACCURACIES = _FS + """, told AS (SELECT "Match" = 'Yes' AS yes, 0.5::DOUBLE AS a, "Felligi_Sunter_Similarity_Score" AS c FROM fs)
SELECT 'Gradient_Boosted_Score' AS model, round(avg(CASE WHEN (a > 0.9) = yes THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(CASE WHEN a > 0.9 THEN 1.0 ELSE 0.0 END) FILTER (yes), 6) AS recall, count(*) AS pairs FROM told
UNION ALL SELECT 'Felligi_Sunter_Similarity_Score', round(avg(CASE WHEN (c > 0.9) = yes THEN 1.0 ELSE 0.0 END), 6),
  round(avg(CASE WHEN c > 0.9 THEN 1.0 ELSE 0.0 END) FILTER (yes), 6), count(*) FROM told
UNION ALL SELECT unnest(['Transformer_Similarity_Score', 'Composite_Score']), NULL, NULL, (SELECT count(*) FROM told)"""
_SAME = " + ".join(f"CASE WHEN lower(translate(l.{f}, {_PUNCT}, '')) = lower(translate(r.{f}, {_PUNCT}, '')) THEN {1 << i} ELSE 0 END" for i, f in enumerate(FIELDS))
_BOTH = " + ".join(f"CASE WHEN l.{f} IS NOT NULL AND r.{f} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, f in enumerate(FIELDS))
AGREEMENTS = f"WITH {_SUBJECTS} SELECT ({_SAME})::INT AS equal, ({_BOTH})::INT AS known, (l.base_id = r.base_id)::INT AS label, count(*) AS n FROM subjects l JOIN subjects r ON l.subject_ord < r.subject_ord GROUP BY 1, 2, 3"
BLOCKED = f"""WITH {_SUBJECTS}, p AS (SELECT (l.base_id = r.base_id)::INT AS y, l.last_name = r.last_name AND coalesce(l.birth_city = r.birth_city, false) AS kept
  FROM subjects l JOIN subjects r ON l.subject_ord < r.subject_ord)
SELECT count(*) FILTER (kept) AS pairs, round(sum(y) FILTER (kept) / sum(y), 6) AS recall FROM p"""
PAIR_LABELS = f"WITH {_SUBJECTS} SELECT l.uuid AS one, r.uuid AS two, 1 AS label FROM subjects l JOIN subjects r ON l.base_id = r.base_id AND l.subject_ord < r.subject_ord"
_BITS = " + ".join(f"CASE WHEN l.{f} IS NOT DISTINCT FROM r.{f} THEN {1 << i} ELSE 0 END" for i, f in enumerate(FIELDS))
PATTERNS = f"WITH {_SUBJECTS} SELECT ({_BITS})::INT AS pattern, (l.base_id = r.base_id)::INT AS label, count(*) AS n FROM subjects l JOIN subjects r ON l.subject_ord < r.subject_ord GROUP BY 1, 2"

NODES = f"WITH {_NODES} SELECT * FROM nodes"
EDGES = f"WITH {_EDGES} SELECT * FROM edges"
COUNTS = f"WITH {_NODES},{_EDGES} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM edges)) AS edge_count"


def neighbors(direction: str) -> str:
    where = "" if direction == "all" else f"WHERE direction = '{direction}'"
    return f"WITH {GRAPH} SELECT DISTINCT node_id, nbr FROM adj {where}"


DEGREE = f"WITH {GRAPH} SELECT node_id, node_ord, degree FROM degrees"
AVG_DEGREE = f"WITH {GRAPH} SELECT round(avg(degree), 6) AS avg_degree FROM degrees"
FIRST_WINS = f"""WITH {_EDGES}, known AS (SELECT * FROM edges WHERE type <> 'trade' OR source[2:]::BIGINT % 2 = 0),
new AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, min(l_orderkey) AS edge_ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT type, count(*) AS n, sum(ord)::BIGINT AS ords FROM (SELECT type, NULL::BIGINT AS ord FROM known
  UNION ALL SELECT 'order', edge_ord FROM new ANTI JOIN known USING (source, target)) GROUP BY type"""
CASCADE = f"WITH {_EDGES} SELECT type, count(*) AS n FROM edges WHERE source[1] <> 'n' AND target[1] <> 'n' GROUP BY type"
DANGLING = f"WITH {_EDGES} SELECT source, target, type FROM edges WHERE source[1] = 's' OR target[1] = 's'"
PATHS = f"""WITH RECURSIVE {GRAPH}, p AS (SELECT ['n0'] AS path UNION ALL
  SELECT list_append(path, nbr) FROM p JOIN nbrs ON node_id = path[-1] WHERE NOT list_contains(path, nbr) AND path[-1] <> 'n1' AND len(path) < 5)
SELECT array_to_string(path, '>') AS path FROM p WHERE path[-1] = 'n1'"""


def clustering(orientation: str) -> str:
    pairs = "SELECT DISTINCT source AS a, target AS b FROM edges WHERE source < target"
    if orientation == "any":
        pairs = "SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target"
    return f"""WITH {GRAPH}, pairs AS ({pairs}),
closed AS (SELECT x.node_id, count(*) AS n FROM pairs JOIN nbrs x ON x.nbr = a JOIN nbrs y ON y.nbr = b AND y.node_id = x.node_id GROUP BY 1)
SELECT d.node_id, round(CASE WHEN degree < 2 THEN 0.0::DOUBLE ELSE coalesce(n, 0) / (degree * (degree - 1) / 2.0::DOUBLE) END, 6) AS clustering
FROM degrees d LEFT JOIN closed USING (node_id)"""


# along location edges everything hangs on its region
COMPONENTS = """SELECT min(node_id) AS component, count(*) AS n FROM (
  SELECT 'r' || r_regionkey AS node_id, r_regionkey AS g FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY g"""

_SEEDS = "seeds AS (SELECT node_id FROM degrees ORDER BY degree DESC, node_ord LIMIT 10)"
SEEDS = f"WITH {GRAPH}, {_SEEDS} SELECT node_id FROM seeds"


def _hash(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


SEEDS_RANDOM = f"WITH {_NODES} SELECT node_id FROM nodes ORDER BY {_hash(chr(39) + '7|seeds|' + chr(39) + ' || node_id')}, node_ord LIMIT 10"
SEEDS_CLUSTERING = f"SELECT node_id FROM ({clustering('ordered').replace('round(', '(').replace(', 6) AS clustering', ') AS clustering')}) JOIN (WITH {_NODES} SELECT node_id, node_ord FROM nodes) USING (node_id) ORDER BY clustering DESC, node_ord LIMIT 10"


def _walk(seeds: str, per: int, length: int) -> str:
    return f"""RECURSIVE {GRAPH}, {seeds},
lists AS (SELECT node_id, list_sort(list(nbr)) AS nbrs FROM nbrs GROUP BY 1),
walks AS (SELECT node_id AS seed, w.i::INT AS walk_id, 0 AS step, node_id AS node FROM seeds, range({per}) w(i)
  UNION ALL SELECT seed, walk_id, step + 1, nbrs[({_hash("concat_ws('|', '7', seed, walk_id, step + 1)")} % len(nbrs) + 1)::INT]
  FROM walks JOIN lists ON node_id = node WHERE step + 1 < {length})"""


def walks(length: int, rest: str) -> str:
    return f"WITH {_walk(_SEEDS, 100, length)} {rest if rest.lstrip().startswith('SELECT') else ', ' + rest}"


_BETWEEN = f"""WITH {_walk("seeds AS (SELECT node_id FROM nodes ORDER BY node_ord LIMIT 50)", 10, 15)},
inner_ AS (SELECT node, count(*) AS n FROM (SELECT *, max(step) OVER (PARTITION BY seed, walk_id) AS last FROM walks) WHERE step > 0 AND step < last GROUP BY 1)"""
BETWEENNESS = _BETWEEN + " SELECT node AS node_id, round(n::DOUBLE / (SELECT max(n) FROM inner_), 6) AS betweenness FROM inner_"
SEEDS_BETWEENNESS = _BETWEEN + " SELECT node_id FROM nodes LEFT JOIN inner_ ON node = node_id ORDER BY coalesce(n, 0) DESC, node_ord LIMIT 10"
_DIV = "div AS (SELECT n.node_id, n.node_ord, count(DISTINCT seed)::DOUBLE / (SELECT count(DISTINCT seed) FROM walks) AS diversity FROM nodes n LEFT JOIN walks ON node = node_id GROUP BY 1, 2)"
DIVERSITY = f"{_DIV} SELECT node_id, round(diversity, 6) AS diversity FROM div"
ATTACK = """SELECT * FROM (SELECT node AS source, target, round(count(*)::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT seed, walk_id FROM walks)), 6) AS frequency
  FROM (SELECT node, lead(node) OVER (PARTITION BY seed, walk_id ORDER BY step) AS target FROM walks) WHERE target IS NOT NULL GROUP BY 1, 2) WHERE frequency > 0.01"""
_GUARD = f"""{_DIV}, pairs AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE source < target),
closed AS (SELECT x.node_id, count(*) AS n FROM pairs JOIN nbrs x ON x.nbr = a JOIN nbrs y ON y.nbr = b AND y.node_id = x.node_id GROUP BY 1),
guard AS (SELECT node_id, least(0.4::DOUBLE * (1 - diversity) + CASE WHEN degree = 0 THEN 0 WHEN degree / m > 3 OR degree / m < 0.3 THEN 0.3::DOUBLE
    ELSE 0.3::DOUBLE * (1 - least(degree / m / 3, 1)) END + 0.3::DOUBLE * (1 - CASE WHEN degree < 2 THEN 0 ELSE coalesce(n, 0) / (degree * (degree - 1) / 2.0::DOUBLE) END), 1.0::DOUBLE) AS score
  FROM div JOIN degrees USING (node_id) LEFT JOIN closed USING (node_id), (SELECT avg(degree) AS m FROM degrees))"""
GUARD = f"{_GUARD} SELECT node_id, round(score, 6) AS score FROM guard"
GUARD_SYBILS = f"{_GUARD} SELECT count(*) AS n FROM guard WHERE score >= 0.7"
GUARD_TOP = f"{_GUARD} SELECT node_id, round(score, 6) AS score FROM guard JOIN nodes USING (node_id) ORDER BY round(score, 6) DESC, node_ord LIMIT 10"
_MIX = """per AS (SELECT seed, walk_id, node AS node_id, max((step < size // 2)::INT) AS early, max((step >= size // 2)::INT) AS late
  FROM (SELECT *, count(*) OVER (PARTITION BY seed, walk_id) AS size FROM walks) GROUP BY 1, 2, 3),
mix AS (SELECT node_id, count(*) AS walks_through, sum(early)::BIGINT AS early, sum(late)::BIGINT AS late, sum(late)::DOUBLE / count(*) AS mixing_ratio,
  count(*)::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT seed, walk_id FROM walks)) AS visit_frequency FROM per GROUP BY 1)"""
MIXING = f"{_MIX} SELECT node_id, walks_through, early, late, round(mixing_ratio, 6) AS mixing_ratio, round(visit_frequency, 6) AS visit_frequency FROM mix"
_BALANCE = f"""{_MIX}, visits AS (SELECT s.node_id AS seed, n.node_id, count(per.walk_id) AS v FROM seeds s CROSS JOIN nodes n LEFT JOIN per ON per.seed = s.node_id AND per.node_id = n.node_id GROUP BY 1, 2),
spread AS (SELECT node_id, var_pop(v) / (avg(v) * avg(v)) AS nv, sum(v) AS s FROM visits GROUP BY 1),
bal AS (SELECT n.node_id, n.node_ord, coalesce(mixing_ratio, 0) AS mr, coalesce(visit_frequency, 0) AS vf,
  CASE WHEN s > 0 THEN least(1 / (1 + nv) + 0.3::DOUBLE * coalesce(mixing_ratio, 0), 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS balance
  FROM nodes n JOIN spread USING (node_id) LEFT JOIN mix USING (node_id)),
acc AS (SELECT node_id, node_ord, least(0.6::DOUBLE * balance + 0.3::DOUBLE * least(2 * vf, 1) + 0.1::DOUBLE * mr, 1.0::DOUBLE) AS acceptance FROM bal)"""
BALANCE = f"{_BALANCE} SELECT node_id, round(balance, 6) AS balance FROM bal"
ACCEPTANCE = f"{_BALANCE} SELECT node_id, round(acceptance, 6) AS acceptance FROM acc"
AVERAGE = f"{_BALANCE} SELECT round(avg(acceptance), 6) AS average FROM acc"
LIMIT_SYBILS = f"{_BALANCE} SELECT count(*) AS n FROM acc WHERE acceptance < 0.2"
TOP_TRUSTED = f"{_BALANCE} SELECT node_id, round(acceptance, 6) AS acceptance FROM acc ORDER BY round(acceptance, 6) DESC, node_ord LIMIT 10"
TOP_SUSPICIOUS = f"{_BALANCE} SELECT node_id, round(acceptance, 6) AS acceptance FROM acc ORDER BY round(acceptance, 6), node_ord LIMIT 10"


def _steps(k: int) -> str:
    return f"""WITH RECURSIVE {GRAPH}, {_SEEDS},
flows AS (SELECT node_id AS src, nbr AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY node_id) AS p FROM nbrs),
begin_ AS (SELECT node_id, (node_id IN (SELECT node_id FROM seeds))::INT::DOUBLE AS s FROM nodes),
steps AS (SELECT 0 AS i, node_id, s, s AS trust FROM begin_ UNION ALL
  SELECT c.i + 1, b.node_id, b.s, 0.85::DOUBLE * coalesce(g.got, 0) + (1 - 0.85::DOUBLE) * b.s
  FROM begin_ b CROSS JOIN (SELECT max(i) AS i FROM steps) c
  LEFT JOIN (SELECT dst, sum(p * trust) AS got FROM steps JOIN flows ON src = node_id GROUP BY dst) g ON g.dst = b.node_id WHERE c.i < {k})"""


def rank_after(k: int, rest: str) -> str:
    """The vector after k steps."""
    return f"{_steps(k)}, ranks AS (SELECT node_id, trust FROM steps WHERE i = {k}) {rest}"


def rank(rest: str) -> str:
    """The vector before the first step shorter than 1e-6, or after 100 steps."""
    return f"""{_steps(100)},
far AS (SELECT a.i, sqrt(sum((a.trust - b.trust) * (a.trust - b.trust))) AS d FROM steps a JOIN steps b ON b.node_id = a.node_id AND b.i = a.i - 1 GROUP BY a.i),
kept AS (SELECT coalesce(min(i) - 1, 100) AS i FROM far WHERE d < 1e-6),
ranks AS (SELECT node_id, trust FROM steps WHERE i = (SELECT i FROM kept)) {rest}"""


STATS = "SELECT round(avg(trust), 6) AS mean, round(median(trust), 6) AS median, round(stddev_pop(trust), 6) AS std, round(min(trust), 6) AS low, round(max(trust), 6) AS high, count(*) FILTER (trust >= 0.1) AS trusted, count(*) AS total FROM ranks"



def _inter(resets: bool) -> str:
    """Interactions, those that the once-only guards let through, and flags; with ``resets`` of actors in between."""
    seq, extra = ("event_id * 2", """
  UNION ALL SELECT event_id * 2 + 1, floor(event_id * 40000000000 / n)::BIGINT, user_id, user_id, 'reset' FROM events, size WHERE event_id % 50 = 0""") if resets else ("event_id", "")
    return f"""size AS (SELECT max(user_id) + 1 AS u, count(*) AS n FROM events),
inter AS (SELECT {seq} AS seq, floor(event_id * 40000000000 / n)::BIGINT AS ts, user_id AS actor, (user_id + 1 + (event_id * 7) % (u - 1)) % u AS target,
  CASE event_type WHEN 'error' THEN 'report' WHEN 'purchase' THEN 'vet' WHEN 'signup' THEN 'deny' ELSE 'accept' END AS action FROM events, size{extra}),
eras AS (SELECT *, count(*) FILTER (action = 'reset') OVER (PARTITION BY actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS epoch,
  min(seq) FILTER (action = 'reset') OVER (PARTITION BY actor ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until_reset FROM inter),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY actor, target, epoch, CASE WHEN action IN ('vet', 'deny') THEN 'vet' ELSE action END ORDER BY seq) AS k FROM eras)
  WHERE action IN ('accept', 'reset') OR k = 1),
ripe AS (SELECT actor, seq AS at, until_reset, CASE action WHEN 'report' THEN lag(ts, 4) OVER w ELSE lag(ts, 29) OVER w END + 3600000000 AS until, ts
  FROM once WHERE action IN ('report', 'accept') WINDOW w AS (PARTITION BY actor, action, epoch ORDER BY seq)),
ticks AS (SELECT seq, ts AS tick FROM inter WHERE action = 'report'),
flags AS (SELECT actor, min(t.seq) AS flagged_seq FROM ripe r ASOF JOIN ticks t ON r.at < t.seq
  WHERE until IS NOT NULL AND tick < until AND (until_reset IS NULL OR t.seq < until_reset) GROUP BY actor),
passed AS (SELECT seq, actor, target, action FROM once LEFT JOIN flags USING (actor) WHERE action <> 'report' OR flagged_seq IS NULL OR seq < flagged_seq)"""


FLAGS = f"WITH {_inter(False)} SELECT actor, flagged_seq FROM flags"
ADMITTED = f"WITH {_inter(False)} SELECT seq, actor, target, action FROM passed"


def trust(what: str, resets: bool = False) -> str:
    """``flags``, ``scores`` or ``log``: one row of the ledger after another, all scores in a list."""
    if what == "flags":
        return f"WITH {_inter(resets)} SELECT actor, flagged_seq FROM flags"
    t, by = "v[target + 1]", "v[actor + 1]"
    swayed = lambda base: f"greatest(0, {base} * (1 + ({by} - 50) * 0.05::DOUBLE))"
    gain = lambda base: f"{base} * pow(least(1, greatest(0, 1 - ({t} - 50) / 50)), 2)"
    loss = lambda base: f"-({base} * sqrt(greatest({by}, 0.001::DOUBLE) / (greatest({t}, 0.001::DOUBLE) + 1)))"
    fold = f"""WITH RECURSIVE {_inter(resets)},
led AS (SELECT row_number() OVER (ORDER BY seq, part, actor) AS i, * FROM (SELECT seq, 1 AS part, actor, target, action FROM passed
  UNION ALL SELECT flagged_seq, 0, actor, actor, 'spam' FROM flags)),
fold AS (SELECT 0::BIGINT AS i, list_transform(range((SELECT u FROM size)), lambda x: 50.0::DOUBLE) AS v, 0.0::DOUBLE AS w
  UNION ALL SELECT i, v[:target] || [CASE action WHEN 'reset' THEN 50.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, {t} + w)) END] || v[target + 2:], w
  FROM (SELECT led.i, v, target, action, (CASE action WHEN 'vet' THEN {gain(swayed('8.0::DOUBLE'))} WHEN 'accept' THEN {gain(swayed('4.0::DOUBLE'))}
      WHEN 'deny' THEN {loss(swayed('5.0::DOUBLE'))} WHEN 'report' THEN {loss('15.0::DOUBLE')} WHEN 'spam' THEN -20.0::DOUBLE ELSE 0.0::DOUBLE END) AS w
    FROM fold JOIN led ON led.i = fold.i + 1))"""
    if what == "scores":
        return f"{fold}, last_ AS (SELECT v FROM fold ORDER BY i DESC LIMIT 1) SELECT username, round(v[username + 1], 6) AS trust_score FROM (SELECT DISTINCT user_id AS username FROM events), last_"
    return f"""{fold}, told AS (SELECT led.*, w FROM led JOIN fold USING (i)), wiped AS (SELECT actor AS username, max(seq) AS upto FROM led WHERE action = 'reset' GROUP BY 1),
sides AS (SELECT target AS username, seq, target::VARCHAR AS actor, CASE action WHEN 'spam' THEN 'system' ELSE actor::VARCHAR END AS target,
    CASE action WHEN 'vet' THEN 'vetted_by' WHEN 'deny' THEN 'vet_denied_by' WHEN 'report' THEN 'reported_by' WHEN 'accept' THEN 'accepted_by' ELSE 'spam_detected' END AS action,
    round(w, 6) AS weight FROM told WHERE action <> 'reset'
  UNION ALL SELECT actor, seq, actor::VARCHAR, target::VARCHAR,
    CASE action WHEN 'vet' THEN 'vetted' WHEN 'deny' THEN 'vet_denied' WHEN 'report' THEN 'reported' ELSE 'accepted' END, 0.0 FROM told WHERE action NOT IN ('reset', 'spam'))
SELECT s.username, seq, actor, target, action, weight FROM sides s LEFT JOIN wiped USING (username) WHERE upto IS NULL OR seq > upto"""


CITY = f"WITH {_SUBJECTS} SELECT coalesce(birth_city, 'unknown') AS city, count(*) AS n FROM subjects GROUP BY 1"
AGE = f"WITH {_SUBJECTS} SELECT (substr(dob, 1, 4)::INT // 10 * 10) || 's' AS decade, count(*) AS n FROM subjects GROUP BY 1"
EMAIL = f"WITH {_SUBJECTS} SELECT split_part(email, '@', 2) AS domain, count(*) AS n FROM subjects GROUP BY 1"
_RELATIVES = """
rel AS (SELECT c_custkey AS node_ord, 'p' || c_custkey AS uuid, 'house' || (c_custkey // 12) AS last_name,
    (1920 + CASE WHEN (c_custkey // 12) % 4 = 0 THEN 0 ELSE 38 * (c_custkey % 3) END + c_custkey * 7 % 18) AS y,
    lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + c_custkey * 5 % 28)::VARCHAR, 2, '0') AS md FROM customer),
born AS (SELECT node_ord, uuid, last_name, y, y || '-' || md AS dob FROM rel)"""


def _kin(people: str, source: str) -> str:
    """gen: surnames cut where over 20 years lie between one person and the next; kin: those with two generations or more."""
    return f"""{people}, gaps AS (SELECT *, (y - lag(y) OVER w > 20)::INT AS gap FROM {source} WINDOW w AS (PARTITION BY last_name ORDER BY dob, uuid)),
gen AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY last_name ORDER BY dob, uuid ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS generation FROM gaps),
kin AS (SELECT gen.*, f AS family_ord, 'family_' || f AS family_id FROM gen JOIN (SELECT last_name, min(node_ord) AS f FROM gen GROUP BY 1 HAVING count(DISTINCT generation) >= 2) USING (last_name))"""


def _tenth(name: str, who: str) -> str:
    return f"{_hash(f"concat_ws('|', '{{seed}}', '{name}', {who})")} % 10"


_PARENTS = "SELECT p.uuid AS source, c.uuid AS target, p.family_id FROM kin p JOIN kin c ON p.family_id = c.family_id AND c.generation = p.generation + 1 AND c.y - p.y BETWEEN 15 AND 50"
_SIBLINGS = "SELECT a.uuid AS source, b.uuid AS target, a.family_id FROM kin a JOIN kin b ON a.family_id = b.family_id AND a.generation = b.generation AND (a.dob, a.uuid) < (b.dob, b.uuid) AND abs(a.y - b.y) <= 15"


def _spouses(people: str, seed: int) -> str:
    one, two = _tenth("spouse one", "p.uuid").replace("{seed}", str(seed)), _tenth("spouse two", "k.uuid").replace("{seed}", str(seed))
    return f"SELECT p.uuid AS source, k.uuid AS target, k.family_id FROM {people} p JOIN kin k ON abs(p.y - k.y) <= 10 AND {one} = {two}"


_GEN = _kin(_RELATIVES, "born")
GENERATIONS = f"WITH {_GEN} SELECT uuid, last_name, generation FROM gen"
FAMILIES = f"WITH {_GEN} SELECT uuid, family_id, generation FROM kin"
PARENT_CHILD = f"WITH {_GEN} {_PARENTS}"
SIBLINGS = f"WITH {_GEN} {_SIBLINGS}"
SPOUSES = f"WITH {_GEN} {_spouses('born', 0)}"
DEDUP = """SELECT source, target, edge_ord FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY edge_ord) AS k
  FROM (SELECT 'p' || (l_partkey % 1000) AS source, 'p' || (l_suppkey % 1000) AS target, l_orderkey * 10 + l_linenumber AS edge_ord FROM lineitem) WHERE source <> target) WHERE k = 1"""
_DRAWN = f"""WITH {_NODES},{_EDGES}, pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target),
deg AS (SELECT n.node_id, count(p) AS degree FROM nodes n LEFT JOIN (SELECT a AS p FROM pairs UNION ALL SELECT b FROM pairs) ON p = n.node_id GROUP BY 1),
w AS (SELECT max(degree) AS most, count(*) AS n FROM deg)"""
VIZ_NODES = f"""{_DRAWN} SELECT node_id, degree, round(greatest(15, least(30, 100 / greatest(1, n / 20))) + degree / most * greatest(20, least(50, 200 / greatest(1, n / 10))), 6) AS size,
  round(greatest(12, least(18, 50 / greatest(1, n / 30))), 6) AS font_size FROM deg, w"""
_TWO = "printf('%02x', floor(({}) * 255)::INT)"
VIZ_COLORS = f"""{_DRAWN}, hue AS (SELECT node_id, (1 - degree::DOUBLE / most) * 0.7::DOUBLE * 6 AS h FROM deg, w),
part AS (SELECT node_id, floor(h)::INT AS i, h - floor(h) AS f, 0.9::DOUBLE AS v, 0.9::DOUBLE * (1 - 0.8::DOUBLE) AS p FROM hue),
tone AS (SELECT node_id, i, v, p, v * (1 - 0.8::DOUBLE * f) AS q, v * (1 - 0.8::DOUBLE * (1 - f)) AS t FROM part)
SELECT node_id, '#' || {_TWO.format("CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 4 THEN t WHEN 5 THEN v ELSE p END")}
  || {_TWO.format("CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END")}
  || {_TWO.format("CASE i WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v WHEN 5 THEN q ELSE p END")} AS color FROM tone"""
VIZ_STYLE = f"""WITH {_NODES},{_EDGES}, w AS (SELECT count(*) AS n FROM nodes)
SELECT source, target, directed, greatest(1, least(4, 10 / greatest(1, n / 50))) AS width, CASE WHEN directed THEN '#aaaaaa' ELSE '#888888' END AS color, NOT directed AS dashes,
  CASE WHEN directed THEN 'directed' ELSE 'undirected' END || ' edge' || chr(10) || 'from: ' || source || chr(10) || 'to: ' || target || chr(10) || 'weight: 1.00' AS title FROM edges, w"""
VIZ_EDGES = f"WITH {_EDGES} SELECT least(source, target) AS a, greatest(source, target) AS b, bool_or(directed) AS directed FROM edges GROUP BY 1, 2"
HIGHLIGHT = f"""WITH {GRAPH} SELECT node_id, min(hops)::INT AS hops FROM (SELECT 'n0' AS node_id, 0 AS hops UNION ALL SELECT nbr, 1 FROM nbrs WHERE node_id = 'n0'
  UNION ALL SELECT b.nbr, 2 FROM nbrs a JOIN nbrs b ON a.nbr = b.node_id WHERE a.node_id = 'n0') GROUP BY 1"""
HOURLY = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2"
SESSIONS = """SELECT user_id, count(*) AS n, round(sum(value), 6) AS value FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS fresh FROM events)) GROUP BY user_id, coalesce(s, 0)"""


# The generator: every value is a function of the seed and a key

_SEED = 7
_FIRST = ("Ada Ben Cleo Dan Eva Finn Gwen Hugo Iris Jack Kate Liam Mona Noah Olga Paul Rosa Sam Tess Victor "
    "William Robert Richard Michael Christopher Matthew Anthony Elizabeth Katherine Jennifer Rebecca Jessica").split()
_STEMS = ("Abbott Barnes Carver Dalton Easton Fisher Garner Harlow Irving Jensen Keller Lowell Mercer Norton Osborn Porter Quincy Ramsey Sutton Turner").split()
_SYLLABLES = ("ba be bi da de do ga la le li ma me mo na ne ra re ri ta to").split()
_ENDINGS = "son ley man ford".split()
_DOMAINS = "gmail.com yahoo.com hotmail.com outlook.com proton.me example.com example.org example.net".split()
_CITIES = "Ashford Brookfield Clearwater Dunmore Eastport Fairview Greenville Hillsboro".split()
_AREAS = "555 800 888 877 866 855 844 833 822 900 901 902 903 904 905 906 907 908 909".split()


def _h(name: str, key: str, seed: int = _SEED) -> str:
    return _hash(f"concat_ws('|', '{seed}', '{name}', {key})")


def _u(name: str, key: str, seed: int = _SEED) -> str:
    return f"({_h(name, key, seed)} / 4294967296.0::DOUBLE)"


def _pick(values: list[str], name: str, key: str, seed: int = _SEED) -> str:
    return f"({values!r})[({_h(name, key, seed)} % {len(values)} + 1)::INT]"


def _phone(key: str, seed: int = _SEED) -> str:
    two, four = (f"lpad(({_h(name, key, seed)} % {10**n})::VARCHAR, {n}, '0')" for name, n in (("ex2", 2), ("line", 4)))
    return f"({_pick(_AREAS, 'area', key, seed)} || ({_h('ex', key, seed)} % 8 + 2) || {two} || {four})"


def _originals(rows: str) -> str:
    """The people of the keys ``k`` in ``rows``."""
    surname = _pick(_STEMS, "last", "whose") + " || " + _pick(_SYLLABLES, "mid one", "whose") + " || " + _pick(_SYLLABLES, "mid two", "whose") + " || " + _pick(_ENDINGS, "end", "whose")
    return f"""(SELECT *, lower(first_name || '.' || last_name || '@' || {_pick(_DOMAINS, 'mail', 'k')}) AS email,
    CASE WHEN year(born) < 1960 AND {_u('dead', 'k')} < 0.15 AND died < DATE '2025-01-01' THEN died::VARCHAR END AS date_of_death, born::VARCHAR AS date_of_birth
  FROM (SELECT *, {_pick(_FIRST, 'first', 'k')} AS first_name, {surname} AS last_name, born + ({_h('died', 'k')} % 29200 + 7300)::INT AS died,
      CASE WHEN {_u('mid?', 'k')} < 0.7 THEN {_pick(_FIRST, 'mid', 'k')} END AS middle_name,
      CASE WHEN {_u('phone?', 'k')} < 0.9 THEN {_phone('k')} END AS phone_number,
      CASE WHEN {_u('city?', 'k')} < 0.8 THEN {_pick(_CITIES, 'city', 'k')} END AS birth_city, substr(md5(concat_ws('|', '{_SEED}', 'base', k)), 1, 8) AS base_uuid
    FROM (SELECT *, DATE '1920-01-01' + ({_h('dob', 'k')} % 36890)::INT AS born,
        CASE WHEN k > 0 AND {_u('reuse', 'k')} < 0.4 THEN {_h('whose', 'k')} % greatest(k, 1) ELSE k END AS whose FROM {rows})))"""


def _typo(c: str, key: str) -> str:
    n, kind = f"length({c})", _pick("adjacent_key double_letter missing_letter vowel_swap transpose common_misspelling".split(), "typo", key)
    at, twice, swap = (f"({_h(name, key)} % greatest({n} - {less}, 1) + {first})" for name, less, first in (("at", 2, 2), ("double", 1, 2), ("swap", 1, 1)))
    vowel = f"list_filter(range(1, {n} + 1), lambda i: lower(substr({c}, i, 1)) IN ('a', 'e', 'i', 'o', 'u', 'y') AND {_u('vowel', f'{key}, i')} < 0.3)[1]"
    return f"""CASE WHEN {n} < 3 THEN {c} ELSE coalesce(CASE {kind}
    WHEN 'adjacent_key' THEN CASE WHEN contains('abcdefghijklmnopqrstuvwxyz', lower(substr({c}, {at}, 1))) THEN substr({c}, 1, {at} - 1) || translate(lower(substr({c}, {at}, 1)), 'abcdefghijklmnopqrstuvwxyz', 'svxswdfguhjknbiowearycqztx') || substr({c}, {at} + 1) ELSE {c} END
    WHEN 'double_letter' THEN substr({c}, 1, {twice}) || substr({c}, {twice})
    WHEN 'missing_letter' THEN CASE WHEN {n} > 3 THEN substr({c}, 1, {at} - 1) || substr({c}, {at} + 1) END
    WHEN 'vowel_swap' THEN substr({c}, 1, {vowel} - 1) || translate(lower(substr({c}, {vowel}, 1)), 'aeiouy', 'eayuoi') || substr({c}, {vowel} + 1)
    WHEN 'transpose' THEN CASE WHEN {n} > 3 THEN substr({c}, 1, {swap} - 1) || reverse(substr({c}, {swap}, 2)) || substr({c}, {swap} + 2) END
    WHEN 'common_misspelling' THEN CASE WHEN contains(lower({c}), 'ph') THEN replace({c}, 'ph', 'f') WHEN contains(lower({c}), 'ck') THEN replace({c}, 'ck', 'k')
      WHEN suffix(lower({c}), 'ie') THEN substr({c}, 1, {n} - 2) || 'y' END END, {c}) END"""


def _varied(rows: str, key: str) -> str:
    """Similar records of ``rows``; ``key`` draws the changes."""
    kinds = "typo_first typo_last typo_first typo_last nickname middle_initial hyphenated_last maiden_name".split()
    span = f"(CASE WHEN {_u('span', key)} < 0.7 THEN 30 WHEN {_u('span', key)} < 0.97 THEN 90 ELSE 365 END)"
    f, n = "lower(new_first)", "lower(new_last)"
    return f"""(SELECT * EXCLUDE (kind, new_first, new_last) REPLACE (new_first AS first_name, new_last AS last_name,
    CASE WHEN kind = 'middle_initial' THEN coalesce(substr(middle_name, 1, 1), {_pick(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "initial", key)}) ELSE middle_name END AS middle_name,
    CASE WHEN {_u('date?', key)} < 0.6 THEN (date_of_birth::DATE + ({_h('days', key)} % (2 * {span} + 1) - {span})::INT)::VARCHAR ELSE date_of_birth END AS date_of_birth,
    CASE WHEN {_u('mail?', key)} < 0.65 THEN CASE {_h('mailkind', key)} % 6 WHEN 0 THEN {f} || '.' || {n} WHEN 1 THEN {f} || {n} WHEN 2 THEN substr({f}, 1, 1) || {n}
      WHEN 3 THEN {f} || '.' || substr({n}, 1, 1) WHEN 4 THEN {f} || '_' || {n} ELSE {f} || ({_h('maildigits', key)} % 90 + 10) END || '@' || {_pick(_DOMAINS, 'mail2', key)} ELSE email END AS email,
    CASE WHEN {_u('tel?', key)} >= 0.4 THEN phone_number WHEN phone_number IS NULL THEN CASE WHEN {_u('add', key)} < 0.2 THEN {_phone(key, _SEED + 1)} END
      WHEN {_u('drop', key)} < 0.3 THEN NULL ELSE {_phone(key, _SEED + 1)} END AS phone_number,
    CASE WHEN {_u('town?', key)} >= 0.2 THEN birth_city WHEN {_u('citykind', key)} < 0.5 THEN NULL ELSE {_pick(_CITIES, 'city2', key)} END AS birth_city)
  FROM (SELECT *, CASE WHEN kind = 'typo_first' THEN {_typo('first_name', key)}
        WHEN kind = 'nickname' THEN CASE first_name WHEN 'William' THEN 'Bill' WHEN 'Robert' THEN 'Bob' WHEN 'Richard' THEN 'Dick' WHEN 'Michael' THEN 'Mike'
          WHEN 'Christopher' THEN 'Chris' WHEN 'Matthew' THEN 'Matt' WHEN 'Anthony' THEN 'Tony' WHEN 'Elizabeth' THEN 'Liz' WHEN 'Katherine' THEN 'Kate'
          WHEN 'Jennifer' THEN 'Jen' WHEN 'Rebecca' THEN 'Becky' WHEN 'Jessica' THEN 'Jess' ELSE first_name END ELSE first_name END AS new_first,
      CASE WHEN kind = 'typo_last' THEN {_typo('last_name', key)} ELSE last_name END AS new_last
    FROM (SELECT *, CASE WHEN {_u('name?', key)} < 0.85 THEN {_pick(kinds, 'name', key)} ELSE 'none' END AS kind FROM {rows})))"""


_ABOUT = "first_name, middle_name, last_name, date_of_birth, date_of_death, email, phone_number, birth_city, base_uuid"
_KEYS = f"""(SELECT id, dup, CASE WHEN dup THEN {_h('of', 'id')} % greatest(id, 1) ELSE id END AS k, dup AND NOT {_u('exact', 'id')} < 0.02 AS alike
  FROM (SELECT c_custkey AS id, c_custkey > 0 AND {_u('dup', 'c_custkey')} < 0.1 AS dup FROM customer))"""
_PEOPLE = f"""made AS MATERIALIZED (SELECT * FROM {_originals(_KEYS)}),
people AS MATERIALIZED (SELECT substr(md5(concat_ws('|', '{_SEED}', 'node', id)), 1, 8) AS node_id, id AS node_ord, {_ABOUT}
  FROM (SELECT * FROM made WHERE NOT alike UNION ALL BY NAME SELECT * FROM {_varied('(SELECT * FROM made WHERE alike)', 'id')}))"""
PEOPLE = f"WITH {_PEOPLE} SELECT * FROM people"
SEQUENCES = f"""WITH first_ AS MATERIALIZED (SELECT * FROM {_originals('(SELECT c_custkey AS k FROM customer)')}),
made AS MATERIALIZED (SELECT first_.*, step, k * 1000 + step AS key FROM first_, range(5) r(step))
SELECT k AS sequence_id, step::INT AS sequence_step, substr(md5(concat_ws('|', '{_SEED}', 'node', key)), 1, 8) AS node_id, (DATE '2024-01-01' + (step * 30)::INT)::VARCHAR AS timestamp,
  (SELECT count(*) FROM customer)::INT AS total_sequences, 5 AS steps_per_sequence, {_ABOUT}
FROM (SELECT * FROM made WHERE step = 0 UNION ALL BY NAME SELECT * FROM {_varied('(SELECT * FROM made WHERE step > 0)', 'key')})"""


def _drawn(rank: int, kind: str, cluster: str, share: str, weight: str = "1.0::DOUBLE", relation: str = "NULL", directed: str = "false") -> str:
    """Draws of two members of a cluster, the clusters weighed by size and ``weight``."""
    return f"""SELECT a.node_id AS source, b.node_id AS target, {directed} AS directed, '{kind}' AS type, {relation} AS relationship, d.c AS detail, ({rank} * 1099511627776 + d.id) AS edge_ord
FROM (SELECT d.id, s.c, {_h(f"{kind}', 'one", 'd.id')} % s.n AS one, {_h(f"{kind}', 'two", 'd.id')} % s.n AS two
  FROM (SELECT id, {_u(kind, 'id')} AS u FROM (SELECT unnest(range({share})) AS id)) d
  JOIN (SELECT *, hi - w AS lo, sum(w) OVER () AS total FROM (SELECT *, sum(w) OVER (ORDER BY c ROWS UNBOUNDED PRECEDING) AS hi
      FROM (SELECT c, count(*) AS n, count(*) * {weight} AS w FROM (SELECT {cluster} AS c FROM people) GROUP BY c HAVING count(*) > 1))) s
    ON d.u * total >= lo AND d.u * total < hi) d
JOIN (SELECT {cluster} AS c, node_id, row_number() OVER (PARTITION BY {cluster} ORDER BY node_ord) - 1 AS i FROM people) a ON a.c = d.c AND a.i = d.one
JOIN (SELECT {cluster} AS c, node_id, row_number() OVER (PARTITION BY {cluster} ORDER BY node_ord) - 1 AS i FROM people) b ON b.c = d.c AND b.i = d.two"""


_MAIL = "c IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com')"
_SIZE = "(SELECT count(*) FROM customer)"
_SMALL = f"{_SIZE} - floor({_SIZE} * 0.25)::BIGINT - floor({_SIZE} * 0.35)::BIGINT - floor({_SIZE} * 0.2)::BIGINT - floor({_SIZE} * 0.15)::BIGINT"
_CONNECTIONS = f"""WITH {_PEOPLE}, {_kin("born AS (SELECT node_ord, node_id AS uuid, last_name, date_of_birth AS dob, substr(date_of_birth, 1, 4)::INT AS y FROM people)", "born")},
family AS (SELECT *, row_number() OVER (ORDER BY substr(family_id, 8)::BIGINT, rank, source, target) - 1 AS edge_ord FROM (
  SELECT *, true AS directed, 'parent_child' AS relationship, 0 AS rank FROM ({_PARENTS}) UNION ALL SELECT *, false, 'sibling', 1 FROM ({_SIBLINGS})
  UNION ALL SELECT *, false, 'spouse', 2 FROM ({_spouses("born", _SEED)})) QUALIFY edge_ord < floor({_SIZE} * 0.25)),
drawn AS (SELECT source, target, directed, 'family' AS type, relationship, family_id AS detail, edge_ord FROM family
  UNION ALL {_drawn(1, "geographic", "coalesce(birth_city, 'unknown')", f"floor({_SIZE} * 0.35)::BIGINT", relation="'neighbor'")}
  UNION ALL {_drawn(2, "age_cohort", "(substr(date_of_birth, 1, 4)::INT // 10 * 10) || 's'", f"floor({_SIZE} * 0.2)::BIGINT", relation="'peer'")}
  UNION ALL {_drawn(3, "workplace", "split_part(email, '@', 2)", f"floor({_SIZE} * 0.15)::BIGINT", f"CASE WHEN {_MAIL} THEN 0.3::DOUBLE ELSE 2.0::DOUBLE END", f"CASE WHEN d.{_MAIL} THEN 'acquaintance' ELSE 'colleague' END")}
  UNION ALL {_drawn(4, "small_world", "'all'", _SMALL, relation="'distant_acquaintance'", directed=f"{_u('way', 'd.id')} < 0.5")}),
linked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY edge_ord) AS k FROM drawn WHERE source <> target) WHERE k = 1)"""
CONNECTIONS = _CONNECTIONS + " SELECT source, target, directed, type, relationship, detail FROM linked"
SUMMARY = _CONNECTIONS + " SELECT type, count(*) AS n FROM linked GROUP BY type"
