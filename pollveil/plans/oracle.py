"""SQL for the registered queries, over the same tables. The prelude derives ballots from the star schema."""

from __future__ import annotations


def prelude(fold: int | None = None, k: int = 10) -> str:
    """fold: line numbers from there on are one contest; None: each is one of its own."""
    number = f"least(l.l_linenumber, {fold})" if fold else "l.l_linenumber"
    return f"""
WITH RECURSIVE lens AS (
  SELECT l.l_orderkey AS voter_id, concat('C', {number}) AS contest, l.l_returnflag AS candidate,
         (l.l_linestatus = 'F' AND l.l_returnflag <> 'N') AS isVote, c.c_nationkey AS precinct, o.o_orderpriority AS priority
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
), votes AS (SELECT DISTINCT voter_id, contest, candidate FROM lens WHERE isVote
), cols AS (SELECT row_number() OVER (ORDER BY contest, candidate) - 1 AS col_idx, contest, candidate AS choice FROM (SELECT DISTINCT contest, candidate FROM votes)
), voters AS (SELECT voter_id, CAST(CAST(min(precinct) AS BIGINT) AS VARCHAR) AS style, min(priority) AS ballot_type, row_number() OVER (ORDER BY voter_id) AS ord FROM lens WHERE isVote GROUP BY voter_id
), present AS (SELECT DISTINCT voter_id, contest FROM votes
), cells AS (
  SELECT v.ord, v.style, c.col_idx, c.contest, c.choice,
         CASE WHEN x.voter_id IS NOT NULL THEN '1' WHEN p.voter_id IS NOT NULL THEN '0' ELSE '' END AS cell
  FROM voters v CROSS JOIN cols c
  LEFT JOIN votes x ON x.voter_id = v.voter_id AND x.contest = c.contest AND x.candidate = c.choice
  LEFT JOIN present p ON p.voter_id = v.voter_id AND p.contest = c.contest
), sigs AS (SELECT ord, string_agg(CASE WHEN cell = '' THEN '0' ELSE '1' END, '' ORDER BY col_idx) AS sig, string_agg(cell, ',' ORDER BY col_idx) AS cell_text FROM cells GROUP BY ord
), patterns AS (SELECT ord, string_agg(p, '' ORDER BY contest) AS pattern FROM (SELECT ord, contest, max(CASE WHEN cell <> '' THEN '1' ELSE '0' END) AS p FROM cells GROUP BY ord, contest) GROUP BY ord
), ballots AS (SELECT v.ord, v.style, v.ballot_type, s.sig, s.cell_text, p.pattern FROM voters v JOIN sigs s USING (ord) JOIN patterns p USING (ord)
), groups AS (SELECT sig, count(*) AS n, min(ord) AS style_ord, count(*) < {k} AS is_rare FROM ballots GROUP BY sig
), names AS (SELECT pattern, n, style_number, concat(length(replace(pattern, '0', '')), CASE WHEN n < {k} THEN 'R' ELSE 'S' END, style_number) AS name
             FROM (SELECT pattern, count(*) AS n, row_number() OVER (ORDER BY pattern) AS style_number FROM ballots GROUP BY pattern)
), rare AS (SELECT b.* FROM ballots b JOIN groups g USING (sig) WHERE g.is_rare
), largest AS (SELECT sig, n FROM groups WHERE n >= {k} ORDER BY n DESC, style_ord LIMIT 1
), missing AS (SELECT {k} - (SELECT count(*) FROM rare) AS needed
), borrowed AS (
  SELECT b.* FROM (SELECT b.*, row_number() OVER (ORDER BY b.ord) AS place, l.n FROM ballots b JOIN largest l USING (sig)) b, missing
  WHERE needed > 0 AND needed < {k} AND ((b.n - needed > 0 AND b.n - needed < {k}) OR b.place <= needed)
), members AS (SELECT ord, sig FROM rare UNION ALL SELECT ord, sig FROM borrowed
), pool AS (
  SELECT b.ord, b.sig, b.style, g.style_ord, count(*) OVER (PARTITION BY b.sig) AS n FROM ballots b JOIN groups g USING (sig)
  WHERE NOT g.is_rare AND b.ord NOT IN (SELECT ord FROM borrowed)
), member_cells AS (SELECT c.* FROM cells c JOIN members m USING (ord)
), counts AS (SELECT contest, choice, CAST(sum(CAST(cell AS BIGINT)) AS BIGINT) AS n FROM member_cells WHERE cell NOT IN ('', '0') GROUP BY contest, choice
), presence AS (SELECT contest, count(*) AS ballots, CAST(count_if(voted) AS BIGINT) AS with_vote FROM (SELECT ord, contest, bool_or(cell <> '') AS on_it, bool_or(cell NOT IN ('', '0')) AS voted FROM member_cells GROUP BY ord, contest) WHERE on_it GROUP BY contest
), needs AS (SELECT contest, {k} - ballots AS need FROM presence WHERE ballots < {k}
), sums AS (SELECT col_idx, contest, choice, CAST(sum(CASE WHEN cell = '1' THEN 1 ELSE 0 END) AS BIGINT) AS total FROM member_cells GROUP BY col_idx, contest, choice
), gaps AS (SELECT c.contest, coalesce(sum(n), 0) AS total, coalesce(max(n), 0) AS most FROM (SELECT DISTINCT contest FROM cols) c LEFT JOIN counts USING (contest) GROUP BY c.contest
), added AS (SELECT c.ord, c.contest, bool_or(c.cell <> '') AS on_it, sum(CASE WHEN c.cell = '1' THEN 1 ELSE 0 END) AS more, max(coalesce(k.n, 0) + CASE WHEN c.cell = '1' THEN 1 ELSE 0 END) AS new_most
             FROM cells c LEFT JOIN counts k USING (contest, choice) GROUP BY c.ord, c.contest
), gains AS (SELECT a.ord, a.contest, CAST(CASE WHEN a.more = 0 THEN 0 ELSE greatest(0, (2 * g.most - g.total) - (2 * a.new_most - (g.total + a.more))) END AS DOUBLE) AS gain FROM added a JOIN gaps g USING (contest) WHERE a.on_it
), picks AS (SELECT ord, contest, min(CASE WHEN cell = '1' THEN col_idx END) AS pick, bool_or(cell <> '') AS on_it FROM cells GROUP BY ord, contest
), tallied AS (SELECT contest, choice, CAST(count(*) AS BIGINT) AS votes FROM cells WHERE cell = '1' GROUP BY contest, choice)
"""


def near(mode: str) -> str:
    votes = "CASE WHEN total = 1 THEN 1 ELSE 0 END" if mode == "compat" else "total"
    return f"""
SELECT contest, winner, winner_votes, total_votes FROM (
  SELECT contest, CAST(sum(v) AS BIGINT) AS total_votes, CAST(max(v) AS BIGINT) AS winner_votes, arg_min(choice, col_idx - 1000000 * v) AS winner
  FROM (SELECT *, {votes} AS v FROM sums) WHERE v > 0 GROUP BY contest)
WHERE total_votes - winner_votes <= 2"""


#: Winners that the contrast queries take as given: the first choice of each contest's columns.
CONTRAST_WINNERS = "SELECT contest, arg_min(choice, col_idx) AS winner, min(col_idx) AS win_col FROM cols GROUP BY contest"

SYNTHETIC = """
SELECT i AS ord, CAST(i AS VARCHAR) AS cvr_number, CASE WHEN i = 1 THEN '1R1' WHEN i <= 11 THEN '2S2' ELSE '1S3' END AS style,
  concat(CASE WHEN i = 1 OR i BETWEEN 2 AND 7 THEN '1' WHEN i <= 11 THEN '0' ELSE '' END, ',',
         CASE WHEN i = 1 OR i BETWEEN 2 AND 7 THEN '0' WHEN i <= 11 THEN '1' ELSE '' END, ',',
         CASE WHEN i = 1 THEN '' WHEN i BETWEEN 2 AND 6 OR i BETWEEN 12 AND 17 THEN '1' ELSE '0' END, ',',
         CASE WHEN i = 1 THEN '' WHEN i BETWEEN 2 AND 6 OR i BETWEEN 12 AND 17 THEN '0' ELSE '1' END) AS cells
FROM range(1, 22) t(i)"""

AGGREGATE_HEADER = "SELECT 'AGGREGATED-1' AS cvr_number, '' AS tabulator, '' AS batch, '' AS record, '' AS imprinted, '' AS counting_group, '' AS style, 'AGGREGATED' AS ballot_type, string_agg(CAST(total AS VARCHAR), ',' ORDER BY col_idx) AS cells FROM sums"
RELEASED = "(SELECT ord FROM ballots WHERE ord NOT IN (SELECT ord FROM members))"
STYLE_SHARES = """
SELECT b.sig AS style, p.contest, c.choice, CAST(count(CASE WHEN p.pick = c.col_idx THEN 1 END) AS DOUBLE) / count(*) AS prob, any_value(g.n) AS ballot_count, any_value(NOT g.is_rare) AS is_common
FROM picks p JOIN ballots b USING (ord) JOIN groups g USING (sig) JOIN cols c ON c.contest = p.contest WHERE p.on_it GROUP BY b.sig, p.contest, c.choice"""
OVERALL = """
SELECT p.contest, c.choice, c.col_idx, count(*) AS eligible, count(CASE WHEN p.pick = c.col_idx THEN 1 END) AS votes,
       CAST(count(CASE WHEN p.pick = c.col_idx THEN 1 END) AS DOUBLE) / count(*) AS prob
FROM picks p JOIN cols c ON c.contest = p.contest WHERE p.on_it GROUP BY p.contest, c.choice, c.col_idx"""
AGG_SHARES = """
SELECT s.contest, s.choice, CASE WHEN t.total > 0 THEN CAST(s.total AS DOUBLE) / t.total ELSE 0 END AS prob, (SELECT greatest(max(x), 1) FROM (SELECT sum(total) AS x FROM sums GROUP BY contest)) AS ballot_count
FROM sums s JOIN (SELECT contest, sum(total) AS total FROM sums GROUP BY contest) t USING (contest)"""

#: Small cells, their donors, and what is hidden with them.
REDACTION = """
, grid AS (
  SELECT c.contest, b.pattern AS style, c.choice, CAST(count_if(c.cell = '1') AS BIGINT) AS votes FROM cells c JOIN ballots b USING (ord) JOIN picks p ON p.ord = c.ord AND p.contest = c.contest WHERE p.on_it GROUP BY ALL
), small AS (
  SELECT g.contest, g.style, g.choice, g.votes, s.choice AS c2, s.votes AS n2, t.style AS r2, t.votes AS m2
  FROM grid g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY contest, style ORDER BY votes, choice) AS k FROM grid WHERE votes >= 10) s ON s.k = 1 AND s.contest = g.contest AND s.style = g.style
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY contest, choice ORDER BY votes, style) AS k FROM grid WHERE votes >= 10) t ON t.k = 1 AND t.contest = g.contest AND t.choice = g.choice
  WHERE g.votes BETWEEN 1 AND 9
), wide AS (
  SELECT m.*, CASE WHEN c2 IS NOT NULL AND r2 IS NOT NULL THEN least(n2, m2) + least(m.votes, coalesce(g.votes, 0)) ELSE coalesce(n2, m2) + m.votes END AS width
  FROM small m LEFT JOIN grid g ON g.contest = m.contest AND g.style = m.r2 AND g.choice = m.c2
), each AS (
  SELECT contest, style, choice, 'primary' AS reason, width FROM wide WHERE c2 IS NOT NULL OR r2 IS NOT NULL
  UNION ALL SELECT contest, style, c2, 'complementary', width FROM wide WHERE c2 IS NOT NULL
  UNION ALL SELECT contest, r2, choice, 'complementary', width FROM wide WHERE r2 IS NOT NULL
  UNION ALL SELECT contest, r2, c2, 'complementary', width FROM wide WHERE c2 IS NOT NULL AND r2 IS NOT NULL
), hidden AS (SELECT contest, style, choice, max(reason) AS reason, max(width) AS width FROM each GROUP BY ALL
), gone AS (SELECT DISTINCT contest FROM small WHERE c2 IS NULL AND r2 IS NULL
), gone_styles AS (SELECT DISTINCT contest, unnest([style, r2]) AS style FROM small WHERE c2 IS NULL AND r2 IS NOT NULL
), gone_choices AS (SELECT DISTINCT contest, unnest([choice, c2]) AS choice FROM small WHERE r2 IS NULL AND c2 IS NOT NULL
), every AS (
  SELECT 'cell' AS kind, g.contest, g.style, g.choice, g.votes, h.reason, h.width FROM grid g LEFT JOIN hidden h USING (contest, style, choice)
  UNION ALL SELECT 'style', contest, style, NULL, CAST(sum(votes) AS BIGINT), CASE WHEN (contest, style) IN (SELECT contest, style FROM gone_styles) THEN 'complementary' END, NULL FROM grid GROUP BY contest, style
  UNION ALL SELECT 'choice', contest, NULL, choice, CAST(sum(votes) AS BIGINT), CASE WHEN (contest, choice) IN (SELECT contest, choice FROM gone_choices) THEN 'complementary' END, NULL FROM grid GROUP BY contest, choice)
SELECT kind, e.contest, style, choice, CASE WHEN g.contest IS NULL AND reason IS NULL THEN votes END AS votes, CASE WHEN g.contest IS NOT NULL THEN 'contest' ELSE reason END AS reason, CASE WHEN g.contest IS NULL THEN width END AS width
FROM every e LEFT JOIN gone g ON g.contest = e.contest"""

#: Contests that the folded queries have: line numbers from FOLD on are one. Every line is read; with so few contests the
#: rare ballots are fewer than the minimum at 0.01, so that borrowing, needs and balancing all have something to do.
FOLD = 5

#: name -> (fold, minimum, SELECT behind the prelude).
SELECTS: dict[str, tuple[int | None, int, str]] = {
    "parquet_long_filter": (None, 10, "SELECT voter_id, contest, candidate, precinct AS precinct FROM lens WHERE isVote"),
    "column_dictionary": (None, 10, "SELECT col_idx, contest, choice FROM cols"),
    "ballot_numbering": (None, 10, "SELECT voter_id, ord AS cvr_number, '1' AS tabulator, '1' AS batch, ord AS record, CAST(voter_id AS VARCHAR) AS imprinted, '1' AS counting_group, '' AS ballot_type FROM voters"),
    "ballot_precinct": (None, 10, "SELECT voter_id, style FROM voters"),
    "wide_cells": (None, 10, "SELECT ord AS cvr, col_idx, cell FROM cells"),
    "style_signature": (None, 10, "SELECT ord AS cvr, sig FROM ballots"),
    "contest_pattern": (None, 10, "SELECT ord AS cvr, pattern FROM ballots"),
    "contests_for_row": (None, 10, "SELECT ord AS cvr, coalesce(string_agg(contest, ',' ORDER BY contest), '') AS contests FROM (SELECT DISTINCT ord, contest FROM cells WHERE cell <> '') GROUP BY ord"),
    "typed_cells": (FOLD, 10, "SELECT ord AS cvr, col_idx, try_cast(cell AS BIGINT) AS number, CASE WHEN cell = '' THEN '' END AS text FROM cells"),
    "style_groups": (None, 10, "SELECT sig, n, style_ord FROM groups"),
    "cvr_style_counts": (None, 10, "SELECT style, count(*) AS n FROM ballots GROUP BY style"),
    "rare_common_split": (None, 10, "SELECT sig, n, is_rare FROM groups"),
    "rare_style_breakdown": (None, 10, "SELECT r.sig, any_value(m.name) AS name, CAST(sum(r.k) AS BIGINT) AS ballot_count, string_agg(concat(r.style, ':', r.k), ',' ORDER BY r.style) AS styles FROM (SELECT sig, style, count(*) AS k FROM rare GROUP BY sig, style) r JOIN (SELECT sig, arg_min(pattern, ord) AS pattern FROM rare GROUP BY sig) f USING (sig) JOIN names m USING (pattern) GROUP BY r.sig"),
    "descriptive_names": (None, 10, "SELECT pattern, n, style_number, name FROM names"),
    "leakage_cvr_style": (None, 10, "SELECT pattern, string_agg(style, '|' ORDER BY style) AS styles FROM (SELECT DISTINCT pattern, style FROM ballots) GROUP BY pattern HAVING count(*) > 1"),
    "leakage_ballot_type": (None, 10, "SELECT pattern, string_agg(ballot_type, '|' ORDER BY ballot_type) AS types FROM (SELECT DISTINCT pattern, ballot_type FROM ballots WHERE ballot_type <> '') GROUP BY pattern HAVING count(*) > 1"),
    "cvr_to_descriptive": (None, 10, "SELECT f.style, n.name FROM (SELECT style, arg_min(pattern, ord) AS pattern FROM ballots GROUP BY style) f JOIN names n USING (pattern)"),
    "aggregate_votes": (None, 10, "SELECT col_idx, CAST(total AS VARCHAR) AS total FROM sums"),
    "aggregate_row_header": (None, 10, AGGREGATE_HEADER),
    "tally": (None, 10, "SELECT contest, choice, votes FROM tallied"),
    "tally_mixed": (None, 10, f"SELECT contest, choice, CAST(sum(v) AS BIGINT) AS votes FROM (SELECT contest, choice, count(*) AS v FROM cells WHERE cell = '1' AND ord IN {RELEASED} GROUP BY contest, choice UNION ALL SELECT contest, choice, total FROM sums) GROUP BY contest, choice HAVING sum(v) > 0"),
    "tally_temp_semantics": (FOLD, 10, "SELECT contest, choice, CAST(1 AS BIGINT) AS votes FROM sums WHERE total = 1"),
    "summary_totals": (None, 10, "SELECT contest, choice, votes FROM tallied"),
    "summary_probabilities": (None, 10, "SELECT n.name, n.pattern, n.n AS ballot_count, e.contest, c.choice, CAST(coalesce(v.votes, 0) AS DOUBLE) / e.eligible AS probability FROM (SELECT pattern, contest, count(*) AS eligible FROM picks JOIN ballots USING (ord) WHERE on_it GROUP BY pattern, contest) e JOIN cols c USING (contest) JOIN names n USING (pattern) LEFT JOIN (SELECT pattern, choice, count(*) AS votes FROM cells JOIN ballots USING (ord) WHERE cell = '1' GROUP BY pattern, choice) v USING (pattern, choice)"),
    "choice_counts": (None, 10, "SELECT contest, choice, n FROM counts"),
    "contest_presence": (None, 10, "SELECT contest, ballots, with_vote FROM presence"),
    "contest_needs": (FOLD, 10, "SELECT contest, need FROM needs"),
    "near_unanimous_spec": (FOLD, 10, near("spec")),
    "near_unanimous_compat": (FOLD, 10, near("compat")),
    "borrow_for_minimum": (FOLD, 10, "SELECT ord, sig FROM borrowed"),
    "imbalance_gain": (FOLD, 10, "SELECT ord, contest, gain FROM gains"),
    "balancing_scores_round1": (FOLD, 10, "SELECT p.ord, count(*) AS coverage, sum(g.gain) AS gain, 10 * count(*) + sum(g.gain) AS score FROM pool p JOIN gains g USING (ord) JOIN needs n USING (contest) WHERE p.n > 10 GROUP BY p.ord"),
    "select_balancing_ballot": (FOLD, 10, "SELECT p.ord, p.sig, 10 * count(*) + sum(g.gain) AS score FROM pool p JOIN gains g USING (ord) JOIN needs n USING (contest) WHERE p.n > 10 GROUP BY p.ord, p.sig, p.style_ord ORDER BY score DESC, p.style_ord, p.ord LIMIT 1"),
    "find_ballots_with_contest": (None, 10, "SELECT p.ord, p.sig FROM pool p JOIN picks k USING (ord) WHERE p.n > 10 AND k.contest = 'C3' AND k.on_it ORDER BY p.style_ord, p.ord LIMIT 25"),
    "contrast_scores": (FOLD, 10, f"SELECT p.ord, count(*) AS score, string_agg(w.contest, ',' ORDER BY w.contest) AS satisfied FROM pool p JOIN (SELECT c.ord, w.contest FROM cells c JOIN ({CONTRAST_WINNERS}) w USING (contest) GROUP BY c.ord, w.contest HAVING bool_and(c.col_idx <> w.win_col OR c.cell <> '1') AND bool_or(c.col_idx <> w.win_col AND c.cell = '1')) w USING (ord) WHERE p.n > 10 GROUP BY p.ord"),
    "largest_common_style": (None, 10, "SELECT sig, n FROM largest"),
    "anti_join_release": (FOLD, 10, f"SELECT ord FROM {RELEASED}"),
    "redact_release": (None, 10, f"SELECT CAST(v.ord AS VARCHAR) AS cvr_number, '1' AS tabulator, CAST(voter_id AS VARCHAR) AS imprinted, '' AS counting_group, '' AS style, cell_text AS cells FROM voters v JOIN ballots USING (ord) WHERE v.ord IN {RELEASED}"),
    "output_sort_keys": (FOLD, 10, f"SELECT CAST(ord AS VARCHAR) AS cvr_number, 0 AS sort_class, ord AS sort_number, CAST(NULL AS VARCHAR) AS sort_text FROM {RELEASED} UNION ALL SELECT 'AGGREGATED-1', 2, 1, NULL"),
    "verify_tally": (None, 10, f"SELECT contest, choice, a.v AS original, coalesce(b.v, 0) AS anonymized, coalesce(b.v, 0) - a.v AS difference FROM (SELECT contest, choice, votes AS v FROM tallied) a LEFT JOIN (SELECT contest, choice, CAST(sum(v) AS BIGINT) AS v FROM (SELECT contest, choice, count(*) AS v FROM cells WHERE cell = '1' AND ord IN {RELEASED} GROUP BY contest, choice UNION ALL SELECT contest, choice, total FROM sums) GROUP BY contest, choice) b USING (contest, choice)"),
    "style_mapping": (None, 10, "SELECT sig AS original_style, CASE WHEN is_rare THEN 'AGGREGATED-1' ELSE sig END AS anonymized_style FROM groups"),
    "style_probabilities": (None, 10, STYLE_SHARES),
    "aggregate_style_probabilities": (None, 10, f"SELECT 'AGGREGATED-1' AS style, contest, choice, prob, CAST(ballot_count AS BIGINT) AS ballot_count, ballot_count >= 10 AS is_common FROM ({AGG_SHARES})"),
    "overall_probabilities": (None, 10, f"SELECT o.*, s.u AS undervote FROM ({OVERALL}) o JOIN (SELECT contest, CAST(max(eligible) - sum(votes) AS DOUBLE) / max(eligible) AS u FROM ({OVERALL}) GROUP BY contest) s USING (contest)"),
    "probability_sheet": (None, 10, f"SELECT concat('V', p.ord) AS voter, CASE WHEN g.is_rare THEN 'AGGREGATED-1' ELSE g.sig END AS style, c.contest, c.choice, CASE WHEN g.is_rare THEN a.prob ELSE s.prob END AS prob FROM picks p JOIN ballots b USING (ord) JOIN groups g USING (sig) JOIN cols c ON c.contest = p.contest LEFT JOIN ({STYLE_SHARES}) s ON s.style = b.sig AND s.contest = c.contest AND s.choice = c.choice LEFT JOIN ({AGG_SHARES}) a ON a.contest = c.contest AND a.choice = c.choice WHERE p.on_it"),
    "style_voter_order": (None, 10, "SELECT ord AS cvr, style, row_number() OVER (ORDER BY first, ord) AS voter FROM (SELECT ord, style, min(ord) OVER (PARTITION BY style) AS first FROM ballots)"),
    "overall_sheet": (FOLD, 10, f"SELECT concat('V', p.ord) AS voter, b.style, o.contest, o.choice, o.prob FROM picks p JOIN ballots b USING (ord) JOIN ({OVERALL}) o ON o.contest = p.contest WHERE p.on_it"),
    "wide_sheet": (None, 10, "SELECT concat('V', p.ord) AS voter, any_value(p.style) AS style, string_agg(CASE WHEN o.prob IS NULL THEN '' WHEN o.prob = 0 THEN '0.0000' WHEN o.prob >= 1 THEN '1.000' ELSE printf('%.4f', o.prob) END, ',' ORDER BY p.col_idx) AS probabilities FROM (SELECT c.ord, c.style, c.col_idx, c.contest, c.choice, k.on_it AND c.ord % 10 <> 0 AS on_it FROM cells c JOIN picks k USING (ord, contest)) p LEFT JOIN (SELECT f.contest, c.choice, CAST(count(CASE WHEN f.pick = c.col_idx THEN 1 END) AS DOUBLE) / count(*) AS prob FROM (SELECT * FROM picks WHERE on_it AND ord % 10 <> 0) f JOIN cols c ON c.contest = f.contest GROUP BY f.contest, c.choice) o ON p.on_it AND o.contest = p.contest AND o.choice = p.choice GROUP BY p.ord"),
    "long_tally_conservation": (None, 10, "SELECT contest, candidate AS choice, CAST(count(DISTINCT voter_id) AS BIGINT) AS long_votes, CAST(count(DISTINCT voter_id) AS BIGINT) AS ballot_votes, CAST(0 AS BIGINT) AS difference FROM lens WHERE isVote GROUP BY contest, candidate"),
    "style_similarity": (None, 10, "SELECT g.sig, CASE WHEN e.u = 0 THEN 1.0 ELSE CAST(e.i AS DOUBLE) / e.u END AS similarity FROM groups g JOIN (SELECT g.sig, count_if(substr(g.sig, x, 1) = '1' AND substr(l.sig, x, 1) = '1') AS i, count_if(substr(g.sig, x, 1) = '1' OR substr(l.sig, x, 1) = '1') AS u FROM groups g, largest l, range(4, 200) t(x) GROUP BY g.sig) e USING (sig)"),
    "style_frequency": (None, 10, "SELECT concat(substr(style, 1, 3), sig) AS legacy_sig, count(*) AS n FROM ballots GROUP BY 1"),
    "column_vectors": (None, 10, "SELECT vector, count(*) AS n FROM (SELECT x, string_agg(substr(sig, x, 1), '' ORDER BY sig) AS vector FROM groups, range(1, 200) t(x) WHERE x <= length(sig) GROUP BY x) GROUP BY vector"),
    "column_cooccurrence": (None, 10, "SELECT x - 1 AS i, y - 1 AS j, concat(substr(sig, x, 1), substr(sig, y, 1)) AS pair, count(*) AS n FROM groups, range(1, 200) a(x), range(1, 200) b(y) WHERE x <= length(sig) AND y <= length(sig) GROUP BY 1, 2, 3"),
    "column_groups": (None, 10, "SELECT min(x) - 1 AS first_col, count(*) AS n, length(replace(vector, '0', '')) AS ones, length(vector) AS styles FROM (SELECT x, string_agg(substr(sig, x, 1), '' ORDER BY sig) AS vector FROM groups, range(1, 200) t(x) WHERE x <= length(sig) GROUP BY x) GROUP BY vector"),
    "entropy_requirements": (FOLD, 10, "SELECT contest, choice, t.votes AS total, least(3, t.votes) AS required, coalesce(n, 0) AS held, greatest(least(3, t.votes) - coalesce(n, 0), 0) AS missing FROM tallied t JOIN (SELECT contest, sum(votes) AS every FROM tallied GROUP BY contest) USING (contest) LEFT JOIN counts USING (contest, choice) WHERE t.votes >= 0.2 * every AND contest IN (SELECT contest FROM presence)"),
    "contest_redaction": (None, 10, REDACTION),
    "undervotes_report": (None, 10, "SELECT contest, ballots AS eligible, with_vote, greatest(ballots - with_vote, 0) AS undervotes FROM presence"),
    "exclude_borrowed_pool": (FOLD, 10, "SELECT sig, count(*) AS n FROM pool WHERE n >= 10 GROUP BY sig"),
}

#: The folded queries over all contests; those of _IDLE, to which these leave nothing to borrow or to balance, folded with
#: half the minimum.
WHOLE_SUFFIX = "_all"
_IDLE = {"near_unanimous_compat", "borrow_for_minimum", "balancing_scores_round1", "select_balancing_ballot"}
WHOLE: dict[str, tuple[int | None, int, str]] = {
    name + WHOLE_SUFFIX: (FOLD, k // 2, select.replace(f"p.n > {k}", f"p.n > {k // 2}")) if name in _IDLE else (None, k, select) for name, (fold, k, select) in SELECTS.items() if fold is not None
}

#: Ballots of each pool with their cells as lists, for the loops.
_LISTS = """
, places AS (SELECT contest, min(col_idx) + 1 AS a, max(col_idx) + 2 AS b, row_number() OVER (ORDER BY contest) AS c FROM cols GROUP BY contest
), profiles AS (
  SELECT p.ord, any_value(p.sig) AS sig, any_value(p.style_ord) AS style_ord, any_value(p.n) AS n, list(CASE WHEN c.cell = '1' THEN 1 ELSE 0 END ORDER BY c.col_idx) AS v, list(CASE WHEN c.cell = '' THEN 0 ELSE 1 END ORDER BY c.col_idx) AS f
  FROM pool p JOIN cells c USING (ord) GROUP BY p.ord
)"""

#: The greedy loop a pick a step: lists of what contests still need, of the columns' counts, and of what was picked.
COVERAGE = _LISTS + """
, start AS (SELECT (SELECT list(coalesce(need, 0) ORDER BY c) FROM places LEFT JOIN needs USING (contest)) AS need, (SELECT list(coalesce(n, 0) ORDER BY col_idx) FROM cols LEFT JOIN counts USING (contest, choice)) AS cnt,
                   (SELECT list(a ORDER BY c) FROM places) AS a, (SELECT list(b ORDER BY c) FROM places) AS b
), steps AS (
  SELECT CAST(-1 AS INTEGER) AS pick, CAST(NULL AS BIGINT) AS ord, need, cnt, CAST([] AS BIGINT[]) AS ords, CAST([] AS VARCHAR[]) AS sigs, a, b FROM start
  UNION ALL
  SELECT pick + 1, ord, [CASE WHEN need[c] > 0 AND list_sum(f[a[c]:b[c] - 1]) > 0 THEN need[c] - 1 ELSE need[c] END for c in range(1, len(need) + 1)], [cnt[i] + v[i] for i in range(1, len(cnt) + 1)], list_append(ords, ord), list_append(sigs, sig), a, b
  FROM (
    SELECT *, row_number() OVER (ORDER BY score DESC, style_ord, ord) AS place FROM (
      SELECT s.pick, p.ord, p.sig, p.style_ord, s.need, s.cnt, s.ords, s.sigs, s.a, s.b, p.v, p.f,
             list_sum([CASE WHEN s.need[c] > 0 AND list_sum(p.f[s.a[c]:s.b[c] - 1]) > 0 THEN 10 + CASE WHEN list_sum(p.v[s.a[c]:s.b[c] - 1]) = 0 THEN 0 ELSE greatest(0,
               2 * list_max(s.cnt[s.a[c]:s.b[c] - 1]) - list_sum(s.cnt[s.a[c]:s.b[c] - 1]) - 2 * list_max([s.cnt[i] + p.v[i] for i in range(s.a[c], s.b[c])]) + list_sum([s.cnt[i] + p.v[i] for i in range(s.a[c], s.b[c])])) END ELSE 0 END for c in range(1, len(s.need) + 1)]) AS score
      FROM steps s, profiles p
      WHERE NOT list_contains(s.ords, p.ord) AND p.n - len([x for x in s.sigs if x = p.sig]) > 10)
    WHERE score > 0)
  WHERE place = 1)
SELECT pick, ord FROM steps WHERE pick >= 0"""

#: The entropy rule's loop: a ballot that votes for most of what is lacking, a pick a step.
ENTROPY = _LISTS + """
, lacking AS (
  SELECT list(coalesce(r.missing, 0) ORDER BY c.col_idx) AS missing FROM cols c LEFT JOIN (
    SELECT contest, choice, greatest(least(3, t.votes) - coalesce(n, 0), 0) AS missing FROM tallied t JOIN (SELECT contest, sum(votes) AS every FROM tallied GROUP BY contest) USING (contest) LEFT JOIN counts USING (contest, choice)
    WHERE t.votes >= 0.2 * every AND contest IN (SELECT contest FROM presence)) r USING (contest, choice)
), steps AS (
  SELECT CAST(-1 AS INTEGER) AS pick, CAST(NULL AS BIGINT) AS ord, missing, CAST([] AS BIGINT[]) AS ords, CAST([] AS VARCHAR[]) AS sigs FROM lacking
  UNION ALL
  SELECT pick + 1, ord, [greatest(0, missing[i] - v[i]) for i in range(1, len(missing) + 1)], list_append(ords, ord), list_append(sigs, sig) FROM (
    SELECT *, row_number() OVER (ORDER BY score DESC, style_ord, ord) AS place FROM (
      SELECT s.pick, p.ord, p.sig, p.style_ord, s.missing, s.ords, s.sigs, p.v, list_sum([CASE WHEN s.missing[i] > 0 THEN p.v[i] ELSE 0 END for i in range(1, len(s.missing) + 1)]) AS score
      FROM steps s, profiles p WHERE NOT list_contains(s.ords, p.ord) AND p.n - len([x for x in s.sigs if x = p.sig]) > 10)
    WHERE score > 0)
  WHERE place = 1)
SELECT pick, ord FROM steps WHERE pick >= 0"""

#: A pick a step: the next ballot of the ranking that has a contest with fewer than three, of a style that can still give.
CONTRAST = f"""
, ranked AS (
  SELECT row_number() OVER (ORDER BY len(satisfied) DESC, style_ord, ord) AS rank, ord, sig, n, satisfied FROM (
    SELECT p.ord, any_value(p.sig) AS sig, any_value(p.style_ord) AS style_ord, any_value(p.n) AS n, list(w.contest) AS satisfied
    FROM pool p JOIN (SELECT c.ord, w.contest FROM cells c JOIN ({CONTRAST_WINNERS}) w USING (contest) GROUP BY c.ord, w.contest HAVING bool_and(c.col_idx <> w.win_col OR c.cell <> '1') AND bool_or(c.col_idx <> w.win_col AND c.cell = '1')) w USING (ord)
    WHERE p.n > 10 GROUP BY p.ord)
), steps AS (
  SELECT CAST(-1 AS INTEGER) AS pick, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS have, CAST([] AS VARCHAR[]) AS sigs
  UNION ALL
  SELECT pick + 1, ord, rank, list_concat(have, satisfied), list_append(sigs, sig) FROM (
    SELECT s.pick, r.ord, r.rank, s.have, s.sigs, r.satisfied, r.sig, row_number() OVER (ORDER BY r.rank) AS place FROM steps s, ranked r
    WHERE r.rank > s.rank AND len([x for x in s.sigs if x = r.sig]) < r.n - 10 AND len([c for c in r.satisfied if len([h for h in s.have if h = c]) < 3]) > 0)
  WHERE place = 1)
SELECT pick, ord FROM steps WHERE pick >= 0"""

FIRST_PRECINCT = """
WITH lines AS (SELECT l_orderkey, l_suppkey, l_linestatus = 'F' AND l_returnflag <> 'N' AS isVote, row_number() OVER () AS place FROM lineitem)
SELECT l_orderkey AS voter_id, CAST(CAST(arg_min(s_nationkey, place) AS BIGINT) AS VARCHAR) AS style, count(DISTINCT s_nationkey) AS precincts
FROM lines JOIN supplier ON l_suppkey = s_suppkey WHERE isVote GROUP BY l_orderkey"""


def oracle_sql() -> dict[str, str]:
    return {name: prelude(fold, k) + select for name, (fold, k, select) in (SELECTS | WHOLE).items()} | {
        "synthetic_case": SYNTHETIC,
        "coverage_loop": prelude(FOLD, 10).rstrip().removesuffix("\n") + COVERAGE,
        "contrast_loop": prelude(None, 10) + CONTRAST,
        "entropy_loop": prelude(FOLD, 10) + ENTROPY,
        "precinct_by_first_vote": FIRST_PRECINCT,
    }
