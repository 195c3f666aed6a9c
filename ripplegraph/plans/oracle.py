"""The same results as ripplegraph.plans.catalog's queries, stated in SQL for another engine. Written from the definitions, not from the plans."""

from __future__ import annotations

from ripplegraph.functions.keyed import COUNTER_FACTOR, FINAL_1, FINAL_2, NODE_FACTOR, SEED_FACTOR, STEP_FACTOR


def _times(x: str, k: int) -> str:
    return f"((({x})::UHUGEINT * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _word(x: str) -> str:
    """A 64-bit whole number as an unsigned one."""
    return f"(CASE WHEN ({x}) < 0 THEN ({x})::HUGEINT + 18446744073709551616::HUGEINT ELSE ({x})::HUGEINT END)"


def unit(seed: str, node: str, step: str, counter: str) -> str:
    total = " + ".join(_times(_word(x), k) for x, k in ((seed, SEED_FACTOR), (node, NODE_FACTOR), (step, STEP_FACTOR), (counter, COUNTER_FACTOR)))
    x = f"(({total}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    for shift, factor in ((30, FINAL_1), (27, FINAL_2)):
        x = f"{_times(f'xor({x}, ({x}) >> {shift})', factor)}::UBIGINT"
    return f"((xor({x}, ({x}) >> 31) >> 11)::DOUBLE / 9007199254740992.0)"


CONTACTS = "SELECT a, b FROM (SELECT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL AND a <> b"
ADJ = f"edges AS ({CONTACTS}), adj AS (SELECT a AS src, b AS dst FROM edges UNION ALL SELECT b, a FROM edges)"
PEOPLE = "people AS (SELECT c_custkey AS id FROM customer)"
SICK = "state AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 300 = 0 THEN 2 ELSE 0 END AS st FROM customer)"
DEGREE = "degree AS (SELECT id, count(src) AS degree FROM people LEFT JOIN adj ON src = id GROUP BY id)"


def next_state(day: str, state: str, seed: int = 777) -> str:
    """SELECT id, st of the day after."""
    hit = unit(str(seed), "s.id", day, "c")
    one = unit(str(seed), "s.id", day, "0")
    return f"""SELECT s.id, CASE WHEN s.st = 0 AND coalesce(k, 0) > 0 AND len(list_filter(range(k), lambda c: {hit} < 0.05)) > 0 THEN 1
      WHEN s.st = 1 AND {one} < 0.2 THEN 2 WHEN s.st = 2 AND {one} < 0.1 THEN 3 ELSE s.st END AS st
    FROM ({state}) s LEFT JOIN (SELECT dst, count(*) AS k FROM adj JOIN ({state}) i ON i.id = src WHERE i.st = 2 GROUP BY dst) ON dst = s.id"""


def states(days: int, extra: str = "") -> str:
    """CTEs s0 .. s<days>: the state on each day."""
    parts = [ADJ, PEOPLE, SICK, "s0 AS MATERIALIZED (SELECT id, st FROM state)"]
    parts += [f"s{d + 1} AS MATERIALIZED ({next_state(str(d), f'SELECT * FROM s{d}')})" for d in range(days)]
    return "WITH RECURSIVE " + ", ".join(parts) + extra


def trace(sources: str, tag: str = "") -> str:
    return f""", src{tag} AS MATERIALIZED ({sources}), hop1{tag} AS MATERIALIZED (SELECT DISTINCT dst AS id FROM adj WHERE src IN (SELECT id FROM src{tag}) AND dst NOT IN (SELECT id FROM src{tag})),
    hop2{tag} AS MATERIALIZED (SELECT DISTINCT dst AS id FROM adj WHERE src IN (SELECT id FROM hop1{tag}) AND dst NOT IN (SELECT id FROM src{tag}) AND dst NOT IN (SELECT id FROM hop1{tag}))"""


TRACED = "(SELECT count(*) FROM src{0}) AS source_count, (SELECT count(*) FROM hop1{0}) + (SELECT count(*) FROM hop2{0}) AS contacts_traced"


def clusters(state: str, tag: str = "") -> str:
    """CTE comp(id, component) of the infectious of a state."""
    return f""", sick{tag} AS MATERIALIZED (SELECT id FROM ({state}) WHERE st = 2),
    near{tag} AS MATERIALIZED (SELECT DISTINCT src, dst FROM adj WHERE src IN (SELECT id FROM sick{tag}) AND dst IN (SELECT id FROM sick{tag})),
    walk{tag} AS (SELECT id, id AS seen FROM sick{tag} UNION SELECT walk{tag}.id, dst FROM walk{tag} JOIN near{tag} ON src = seen),
    comp{tag} AS MATERIALIZED (SELECT id, min(seen) AS component FROM walk{tag} GROUP BY id)"""


CLUSTERED = "(SELECT count(DISTINCT component) FROM comp{0}) AS clusters, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM comp{0} GROUP BY component)), 0) AS {1}"


def pagerank(rounds: int = 20) -> str:
    """CTE ranks(id, score) after so many rounds; needs adj and people. Summed as the definition says, slot by slot."""
    parts = [", " + DEGREE, "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM people) AS score FROM people)"]
    for i in range(rounds):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT id, 0.15::DOUBLE / (SELECT count(*) FROM people) + 0.85::DOUBLE * coalesce(got, 0) AS score FROM people LEFT JOIN (
          SELECT dst, sum(score / degree) AS got FROM adj JOIN r{i} ON r{i}.id = src JOIN degree ON degree.id = src GROUP BY dst) ON dst = id)""")
    return ", ".join(parts)


TIMINGS = """timings AS (SELECT l_returnflag || l_linestatus AS label, [1, 2, 4, 8][1 + (l_linenumber % 4)::INT] AS processes, [1, 2, 4, 8][1 + (l_suppkey % 4)::INT] AS threads,
    (100000 * (1 + l_partkey % 2))::INT AS people, CASE WHEN l_orderkey % 2 = 0 THEN 'smallworld' ELSE 'scalefree' END AS network,
    l_quantity + l_discount AS seconds, l_discount AS comm_seconds, 1.0 + l_tax AS imbalance, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""
APPROACH = "CASE WHEN processes = 1 AND threads = 1 THEN 'sequential' WHEN processes = 1 THEN 'threads only' WHEN threads = 1 THEN 'processes only' ELSE 'hybrid' END"
BEST = "best AS (SELECT label, processes, threads, people, network, seconds, comm_seconds, imbalance FROM (SELECT *, row_number() OVER (PARTITION BY label, processes, threads, people, network ORDER BY seconds, seq) AS k FROM timings) WHERE k = 1)"
GRID = f"""med AS (SELECT processes, threads, median(seconds) AS m, min(seconds) AS least, max(seconds) AS most, median(comm_seconds) AS c FROM timings GROUP BY ALL),
  grid AS (SELECT processes * threads AS workers, processes, threads, {APPROACH} AS approach, round(m, 6) AS median_seconds, least, most,
    round(CASE WHEN least > 0 THEN 100.0 * (most - least) / least ELSE 0 END, 6) AS spread_percent, round((SELECT m FROM med WHERE processes = 1 AND threads = 1) / m, 6) AS speedup, round(c, 6) AS comm FROM med)"""
BEST_OF = "best_of AS (SELECT approach, processes, threads, median_seconds, least, most, speedup FROM (SELECT *, row_number() OVER (PARTITION BY approach ORDER BY speedup DESC, workers, processes) AS k FROM grid WHERE approach <> 'sequential') WHERE k = 1)"
TIMELINE = "timeline AS (SELECT event_type AS task, epoch(ts)::DOUBLE AS start, epoch(ts) + value AS stop FROM events)"
OWN = "((src * 8) // (SELECT count(*) FROM people))::INT AS src_owner, ((dst * 8) // (SELECT count(*) FROM people))::INT AS dst_owner"
GHOSTS = f"cut AS (SELECT src, dst, {OWN} FROM adj), ghosts AS (SELECT DISTINCT dst_owner AS owner, src_owner AS neighbour, src FROM cut WHERE src_owner <> dst_owner)"


def summary(degrees: str) -> str:
    return f"""ordered AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM ({degrees}))
    SELECT round(avg(degree), 6) AS mean, max(degree) FILTER (WHERE i = n // 2) AS median, max(degree) FILTER (WHERE i = floor(n * 0.99)) AS p99, max(degree) AS largest,
      round(coalesce(sum(degree) FILTER (WHERE i >= floor(n * 0.99)), 0) / nullif(sum(degree), 0)::DOUBLE, 6) AS top_share,
      round(max(degree) / nullif(max(degree) FILTER (WHERE i = n // 2), 0)::DOUBLE, 6) AS largest_to_median FROM ordered"""


def small_world(n: int, seed: int) -> str:
    u, v = unit(str(seed), "e", "0", "0"), unit(str(seed), "e", "0", "1")
    return f"""WITH ring AS (SELECT e // 3 AS a, ((e // 3) + 1 + e % 3) % {n} AS nxt, {u} AS u, floor({v} * {n})::BIGINT AS other FROM range({3 * n}) t(e))
    SELECT a, CASE WHEN u < 0.1 AND other <> a THEN other ELSE nxt END AS b FROM ring"""


def response(days: int, every: int, vaccines: int) -> str:
    """The response loop unrolled: s<d> is the state before day d, m<d> after its spread."""
    parts = [ADJ, PEOPLE, SICK, "s0 AS MATERIALIZED (SELECT id, st FROM state)"]
    text = "WITH RECURSIVE " + ", ".join(parts) + pagerank()
    rows = []
    for d in range(days):
        text += f", m{d} AS MATERIALIZED ({next_state(str(d), f'SELECT * FROM s{d}')})"
        text += trace(f"SELECT m{d}.id FROM m{d} JOIN s{d} USING (id) WHERE s{d}.st = 0 AND m{d}.st <> 0", f"_{d}") + clusters(f"SELECT * FROM m{d}", f"_{d}")
        if d % every == 0:
            text += f", t{d} AS MATERIALIZED (SELECT id FROM r20 JOIN m{d} USING (id) WHERE st = 0 ORDER BY round(score * (SELECT count(*) FROM people), 6) DESC, id LIMIT {vaccines})"
            text += f", s{d + 1} AS MATERIALIZED (SELECT id, CASE WHEN id IN (SELECT id FROM t{d}) THEN 3 ELSE st END AS st FROM m{d})"
        else:
            text += f", s{d + 1} AS MATERIALIZED (SELECT id, st FROM m{d})"
        number = ", ".join(f"(SELECT count(*) FROM s{d + 1} WHERE st = {i}) AS {name}" for i, name in enumerate(("susceptible", "exposed", "infectious", "recovered")))
        rows.append(f"SELECT {d + 1}::BIGINT AS step, {number}, {TRACED.format(f'_{d}').replace('source_count', 'newly_infected')}, {CLUSTERED.format(f'_{d}', 'largest_cluster')}, {f'(SELECT count(*) FROM t{d})' if d % every == 0 else '0::BIGINT'} AS vaccinated")
    return text + " " + " UNION ALL ".join(rows)


def copy_model(n: int, m: int, seed: int) -> str:
    """Each end followed to the person it names, copy by copy."""
    return f"""WITH RECURSIVE ends AS (SELECT e, floor({unit(str(seed), "e", "0", "0")} * 2 * (e // {m} * {m}))::BIGINT AS pick FROM range({m}, {n * m}) t(e)),
      walk AS (SELECT e, pick FROM ends UNION ALL SELECT walk.e, ends.pick FROM walk JOIN ends ON ends.e = walk.pick // 2 WHERE walk.pick % 2 = 1),
      known AS (SELECT e // {m} AS a, CASE WHEN pick % 2 = 0 THEN pick // {2 * m} ELSE 0 END AS b FROM walk WHERE pick % 2 = 0 OR pick // 2 < {m})
    SELECT a, b FROM known WHERE a <> b"""


def scheduled(days: int, every: int, vaccines: int) -> str:
    """The scheduler's answers: s<d> is the state before day d, m<d> after its spread, t<d> whom to vaccinate before the next day."""
    text = "WITH RECURSIVE " + ", ".join([ADJ, PEOPLE, SICK, "s0 AS MATERIALIZED (SELECT id, st FROM state)"]) + pagerank()
    rows, number = [], 0
    for d in range(days):
        text += f", m{d} AS MATERIALIZED ({next_state(str(d), f'SELECT * FROM s{d}')})"
        text += trace(f"SELECT id FROM m{d} WHERE st = 2", f"_{d}") + clusters(f"SELECT * FROM m{d}", f"_{d}")
        jobs = [("B", f"(SELECT count(*) FROM src_{d}), (SELECT count(*) FROM hop1_{d}) + (SELECT count(*) FROM hop2_{d})"), ("D", CLUSTERED.format(f"_{d}", "largest").replace(" AS clusters", "").replace(" AS largest", ""))]
        after = f"SELECT id, st FROM m{d}"
        if d % every == 0:
            text += f", t{d} AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY round(score * (SELECT count(*) FROM people), 6) DESC, id) AS k FROM r20 JOIN m{d} USING (id) WHERE st = 0 QUALIFY k <= {vaccines})"
            jobs.append(("C", f"(SELECT count(*) FROM t{d}), coalesce((SELECT id FROM t{d} WHERE k = 1), -1)"))
            after = f"SELECT id, CASE WHEN id IN (SELECT id FROM t{d}) THEN 3 ELSE st END AS st FROM m{d}"
        text += f", s{d + 1} AS MATERIALIZED ({after})"
        for task, values in jobs:
            rows.append(f"SELECT {number}::BIGINT, '{task}', {d}::INT, 'COMPLETED', {values}")
            number += 1
    return f"{text}, jobs(task_id, task, step, status, value1, value2) AS ({' UNION ALL '.join(rows)}) SELECT * FROM jobs"


def machines() -> str:
    """Speed-ups of the runs with 100,000 people beside those with 200,000."""
    side = """SELECT series, m.processes * m.threads AS workers, round(b.m / m.m, 6) AS speedup FROM med m JOIN med b ON b.people = m.people AND b.processes = 1 AND b.threads = 1,
      (VALUES ('processes'), ('threads')) v(series) WHERE m.people = {} AND CASE series WHEN 'processes' THEN m.threads ELSE m.processes END = 1"""
    return f"""WITH {TIMINGS}, med AS (SELECT people, processes, threads, median(seconds) AS m FROM timings GROUP BY ALL), x AS ({side.format(100000)}), y AS ({side.format(200000)})
    SELECT series, workers, x.speedup AS here, y.speedup AS there, round(x.speedup / y.speedup, 6) AS lead FROM x FULL JOIN y USING (series, workers)"""
