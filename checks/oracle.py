"""DuckDB SQL for the registered queries.

Written independently of the Spark plans: as-of features by inequality joins,
first rows by row_number, name matching by theta joins. Only the CTEs of the
derived input tables are shared text.
"""

from .derived import FEED_FLAT, FEED_SEASON, START_SEASON, sql_chain

FIRST = """first_rows as (
  select * exclude (rn) from (
    select *, row_number() over (partition by match_id order by innings, ball_no) as rn from deliveries)
  where rn = 1),
sides1 as (
  select match_id, batting_team as team1, bowling_team as team2 from (
    select *, row_number() over (partition by match_id order by ball_no) as rn from deliveries where innings = 1)
  where rn = 1)"""

MATCHES = FIRST + """,
matches as (
  select f.league, f.match_id, try_cast(trim(split_part(f.season, '/', 1)) as int) as season,
    trim(s.team1) as team1, trim(s.team2) as team2, trim(f.match_won_by) as winner,
    trim(f.toss_winner) as toss_winner, trim(f.toss_decision) as toss_decision, f.venue, f.city, lower(f.stage) as stage
  from first_rows f join sides1 s using (match_id)
  where try_cast(trim(split_part(f.season, '/', 1)) as int) is not null
    and s.team1 is not null and s.team2 is not null
    and f.match_won_by is not null
    and lower(trim(f.match_won_by)) not in ('no result', 'tie', 'draw', 'nan', ''))"""
MATCH_COLS = "match_id, season, team1, team2, winner, toss_winner, toss_decision, venue, city, stage"

CHAMPS = """champs as (
  select season, winner as champion from (
    select *, row_number() over (partition by season order by (stage like '%final%') desc, match_id desc) as rn
    from matches) where rn = 1)"""

SIDES = """sides as (
  select match_id, season, team1 as team, winner, toss_winner from matches
  union all
  select match_id, season, team2 as team, winner, toss_winner from matches where team2 <> team1)"""

SEASONS = "seas as (select season, row_number() over (order by season) as k from (select distinct season from matches))"


def _measures(last):
    """Feature expressions over past sides ``s``; ``last`` marks the three latest seasons."""
    return f"""count(*) filter (s.winner = s.team) / count(*)::double as win_rate,
    coalesce(count(*) filter ({last} and s.winner = s.team) / nullif(count(*) filter ({last}), 0)::double, 0) as recent_win_rate,
    count(*) filter (s.toss_winner = s.team) / count(*)::double as toss_win_rate,
    coalesce(count(*) filter (s.toss_winner = s.team and s.winner = s.team)
      / nullif(count(*) filter (s.toss_winner = s.team), 0)::double, 0) as toss_to_win_rate,
    count(*) as total_matches, count(distinct s.season) as seasons_played"""


FEATURE_LIST = "team, win_rate, recent_win_rate, titles, toss_win_rate, toss_to_win_rate, total_matches, seasons_played"


def features(cutoff=None):
    """CTEs up to ``feat``: all-time features, or those before a season."""
    past = f"m0 as (select * from matches_all where season < {cutoff})" if cutoff else "m0 as (select * from matches_all)"
    return (
        MATCHES.replace("matches as (", "matches_all as (") + f",\n{past},\nmatches as (select * from m0),\n"
        + ",\n".join([CHAMPS, SIDES, SEASONS]) + f""",
feat0 as (
  select s.team, {_measures("k.k > (select max(k) from seas) - 3")}
  from sides s join seas k on k.season = s.season group by s.team),
feat as (
  select f.*, (select count(*) from champs c where c.champion = f.team) as titles from feat0 f)"""
    )


PIT = ",\n".join([MATCHES, CHAMPS, SIDES, SEASONS]) + f""",
seen0 as (
  select n.season, s.team, {_measures("k.k >= n.k - 3")}
  from seas n join sides s on s.season < n.season join seas k on k.season = s.season
  group by n.season, s.team),
seen as (
  select f.*, (select count(*) from champs c where c.champion = f.team and c.season < f.season) as titles
  from seen0 f where exists (select 1 from sides p where p.season = f.season and p.team = f.team)),
h2h_seen as (
  select n.season, p.team1, p.team2, coalesce(count(*) filter (m.winner = p.team1) / nullif(count(m.match_id), 0)::double, 0.5) as rate
  from seas n
  join (select distinct season, team1, team2 from matches) p on p.season = n.season
  left join matches m on m.season < n.season
    and ((m.team1 = p.team1 and m.team2 = p.team2) or (m.team1 = p.team2 and m.team2 = p.team1))
  group by all)"""


def _training(digits=None):
    def r(expr):
        return f"cast(printf('%.{digits}f', {expr}) as double)" if digits else expr

    cols = []
    for side, f in (("t1", "a"), ("t2", "b")):
        cols += [
            f"{r(f + '.win_rate')} as {side}_win_rate", f"{r(f + '.recent_win_rate')} as {side}_recent_win_rate",
            f"{f}.titles as {side}_titles", f"{r(f + '.toss_win_rate')} as {side}_toss_win_rate",
            f"{r(f + '.toss_to_win_rate')} as {side}_toss2win_rate", f"{f}.seasons_played as {side}_seasons",
        ]
    return f"""training as (
  select {', '.join(cols)},
    case when m.toss_winner = m.team1 then 1 else 0 end as toss_winner_is_t1, {r('h.rate')} as t1_h2h_win_rate,
    case when m.winner = m.team1 then 1 else 0 end as team1_wins, m.team1, m.team2, m.season, m.match_id
  from matches m
  join seen a on a.season = m.season and a.team = m.team1
  join seen b on b.season = m.season and b.team = m.team2
  join h2h_seen h on h.season = m.season and h.team1 = m.team1 and h.team2 = m.team2
  where m.season >= {START_SEASON})"""


TRAINING = PIT + ",\n" + _training()

RECORDS = """rec as (
  select least(team1, team2) as side_a, greatest(team1, team2) as side_b, count(*) as meetings,
    count(*) filter (winner = least(team1, team2)) as a_wins, count(*) filter (winner = greatest(team1, team2)) as b_wins
  from matches group by 1, 2)"""


def h2h(t1, t2):
    """Directed all-time rate, 0.5 for pairs that never met."""
    return f"""coalesce((select count(*) filter (m.winner = {t1}) / nullif(count(*), 0)::double from matches m
      where (m.team1 = {t1} and m.team2 = {t2}) or (m.team1 = {t2} and m.team2 = {t1})), 0.5)"""


def p1(toss="0.5e0"):
    return (f"0.52e0 + 0.3e0 * (f1.win_rate - f2.win_rate) + 0.2e0 * (o.rate - 0.5e0) + 0.1e0 * ({toss} - 0.5e0)")


FORECAST = features() + f""",
valid as (select r.* from roster r join feat using (team)),
ordered as (
  select a.ord as ord1, b.ord as ord2, a.team as team1, b.team as team2, {h2h('a.team', 'b.team')} as rate
  from valid a join valid b on a.ord <> b.ord),
scored as (
  select o.*, {p1()} as p1 from ordered o join feat f1 on f1.team = o.team1 join feat f2 on f2.team = o.team2)"""


def standings(legs=2):
    leg = "" if legs == 2 else " where ord1 < ord2"
    return f"""points as (
  select team, sum(p) as points from (
    select team1 as team, 2.0e0 * p1 as p from scored{leg}
    union all select team2, 2.0e0 * (1.0e0 - p1) from scored{leg}) group by team),
table_ as (
  select cast(row_number() over (order by pts desc, ord) as int) as rank, team, pts as expected_points
  from (select v.ord, v.team, cast(printf('%.1f', coalesce(points, 0)) as double) as pts
        from valid v left join points using (team)))"""


BRACKET = FORECAST + ",\n" + standings() + """,
seed as (
  select max(team) filter (rank = 1) as s1, max(team) filter (rank = 2) as s2,
    max(team) filter (rank = 3) as s3, max(team) filter (rank = 4) as s4 from table_),
opening as (
  select 1 as stage_no, 'Qualifier 1' as stage, s1 as t1, s2 as t2 from seed
  union all select 2, 'Eliminator', s3, s4 from seed),
played as (
  select g.*, p1, case when p1 >= 0.5e0 then t1 else t2 end as winner, case when p1 >= 0.5e0 then t2 else t1 end as loser
  from opening g join scored on team1 = t1 and team2 = t2),
second as (
  select 3 as stage_no, 'Qualifier 2' as stage, q.loser as t1, e.winner as t2
  from played q, played e where q.stage_no = 1 and e.stage_no = 2),
second_played as (
  select g.*, p1, case when p1 >= 0.5e0 then t1 else t2 end as winner, case when p1 >= 0.5e0 then t2 else t1 end as loser
  from second g join scored on team1 = t1 and team2 = t2),
last_game as (
  select 4 as stage_no, 'Final' as stage, q.winner as t1, s.winner as t2 from played q, second_played s where q.stage_no = 1),
last_played as (
  select g.*, p1, case when p1 >= 0.5e0 then t1 else t2 end as winner, case when p1 >= 0.5e0 then t2 else t1 end as loser
  from last_game g join scored on team1 = t1 and team2 = t2),
bracket as (
  select stage_no, stage, t1, t2, winner, greatest(p1, 1.0e0 - p1) as prob
  from (select * from played union all select * from second_played union all select * from last_played))"""

NAMES = MATCHES + """,
known as (select team1 as team from matches union select team2 from matches),
raw_names as (select team1 as raw from feed union select team2 from feed),
cleaned as (select raw, nullif(lower(trim(raw)), '') as name from raw_names),
fuzzy as (
  select c.raw, min(k.team) as team from cleaned c join known k
    on contains(c.name, lower(k.team)) or contains(lower(k.team), c.name)
      or len(list_intersect(list_distinct(string_split(c.name, ' ')), list_distinct(string_split(lower(k.team), ' ')))) >= 2
  group by c.raw),
named as (
  select c.raw, coalesce(al.canonical, fz.team) as canonical
  from cleaned c left join alias_map al on al.alias = c.name left join fuzzy fz on fz.raw = c.raw)"""

FEED = ", ".join(FEED_FLAT)


def _dedup(source):
    return f"""(select * exclude (rn) from (
    select *, row_number() over (partition by team1, team2, date order by endpoint_no, page_no, item_no) as rn
    from {source}) where rn = 1)"""


SPLIT_ORDER = "(match_id * 7919 + 42) % 104729, match_id"
SPLIT = TRAINING + f""",
sizes as (select team1_wins, count(*) as n from training group by 1),
total as (select count(*) as n, count(*) - cast(ceil(count(*) * 0.2e0) as bigint) as n_train from training),
quota0 as (
  select s.team1_wins, (s.n * t.n_train) // t.n as base, (s.n * t.n_train) % t.n as rest, t.n_train from sizes s, total t),
quota as (
  select team1_wins, base + case when row_number() over (order by rest desc, team1_wins) <= n_train - sum(base) over ()
    then 1 else 0 end as quota from quota0),
split as (
  select t.*, row_number() over (partition by team1_wins order by {SPLIT_ORDER}) <= quota as is_train
  from training t join quota using (team1_wins)),
folds as (
  select *, cast((row_number() over (order by team1_wins, {SPLIT_ORDER}) - 1) % 5 as int) as fold from training)"""


def _guess(source, where=""):
    return f"""(select *, case when 0.52e0 + 0.3e0 * (t1_win_rate - t2_win_rate) + 0.2e0 * (t1_h2h_win_rate - 0.5e0)
      + 0.1e0 * (toss_winner_is_t1 - 0.5e0) >= 0.5e0 then 1 else 0 end as prediction from {source} {where})"""


TEST = _guess("split", "where not is_train")

O = ORACLE_SQL = {}


def oracle(name, ctes, select):
    chain = sql_chain() + (",\n" + ctes if ctes else "")
    ORACLE_SQL[name] = f"with {chain}\n{select}"


# sources and sinks
oracle("scan_csv_roundtrip", MATCHES, f"select {MATCH_COLS} from matches")
oracle("normalize_columns", "", "select c_custkey as cust_key, c_name as customer_name, c_mktsegment as segment from customer")
oracle("matches_passthrough", "", """select mid as match_id, yr as season, home as team1, away as team2, away as winner,
  case when mid % 500 = 0 then 'final' else 'league' end as stage from contest where order_status <> 'P'""")
oracle("training_schema_default", TRAINING, "select match_id, t1_win_rate, 0.5e0 as t1_h2h_win_rate from training")
oracle("feed_parse", "", f"select {FEED} from feed where endpoint_no = 0")
oracle("feed_union", "", f"select {FEED} from feed")
oracle("feed_winner_lookup", "", "select endpoint_no, page_no, team1, team2, winner from feed where winner <> ''")
oracle("training_sink_roundtrip", TRAINING, "select * from training")

# deliveries to matches
oracle("match_first_row", FIRST, "select * exclude (league), league from first_rows")
oracle("innings1_sides", FIRST, "select * from sides1")
oracle("match_sides_left_join", FIRST, """select match_id, season, team1, team2, match_won_by, stage
  from first_rows left join sides1 using (match_id)""")
oracle("match_grain", FIRST, """select match_id, season, match_won_by, stage, team1, team2
  from first_rows left join sides1 using (match_id)""")
oracle("team_universe", MATCHES, "select team1 as team from matches union select team2 from matches")
oracle("winner_column_overlap", FIRST, """, teams as (select batting_team as team from deliveries union select bowling_team from deliveries)
select 'match_won_by' as candidate, count(distinct match_won_by) filter (trim(match_won_by) in (select team from teams)) as overlap from first_rows
union all
select 'win_outcome', count(distinct win_outcome) filter (trim(win_outcome) in (select team from teams)) from first_rows""")
oracle("season_parse", FIRST, """select match_id, season as season_text, try_cast(trim(split_part(season, '/', 1)) as int) as season
  from first_rows where try_cast(trim(split_part(season, '/', 1)) as int) is not null""")
oracle("drop_missing_sides", FIRST, "select match_id, team1, team2 from sides1 where team1 is not null and team2 is not null")
oracle("drop_undecided", FIRST, """select match_id, match_won_by from first_rows
  where lower(trim(match_won_by)) not in ('no result', 'tie', 'draw', 'nan', '')""")
oracle("match_projection", FIRST, """select match_id, try_cast(trim(split_part(season, '/', 1)) as int) as season, trim(team1) as team1,
  trim(team2) as team2, trim(match_won_by) as winner, trim(toss_winner) as toss_winner, trim(toss_decision) as toss_decision,
  venue, '' as city, lower(stage) as stage
  from first_rows left join sides1 using (match_id) where try_cast(trim(split_part(season, '/', 1)) as int) is not null""")
oracle("deliveries_to_matches", MATCHES, f"select {MATCH_COLS} from matches")
oracle("matches_sorted", MATCHES, "select season, match_id, winner from matches order by season, match_id")
oracle("conversion_summary", MATCHES, """select count(*) as matches,
  array_to_string(list_sort(list(distinct season)), ',') as seasons from matches""")

# descriptive aggregates
oracle("dataset_profile", MATCHES, """select count(*) as matches, count(distinct season) as seasons, min(season) as first_season,
  max(season) as last_season, (select count(*) from (select team1 from matches union select team2 from matches)) as teams from matches""")
oracle("preview_head", MATCHES, f"select {MATCH_COLS} from matches order by season, match_id limit 3")
oracle("champions_last_match", MATCHES, """select season, winner as champion from matches m
  where match_id = (select max(match_id) from matches x where x.season = m.season)""")
oracle("champions_final_stage", MATCHES + ",\n" + CHAMPS, "select season, champion from champs")
oracle("title_counts", MATCHES + ",\n" + CHAMPS, "select champion as team, count(*) as titles from champs group by 1 order by 2 desc, 1")
oracle("toss_impact", MATCHES, """select count(*) filter (toss_winner = winner) as toss_and_match,
  count(*) filter (toss_winner = winner) / count(*)::double * 100 as toss_win_pct,
  100.0e0 - count(*) filter (toss_winner = winner) / count(*)::double * 100 as toss_loss_pct from matches""")
oracle("toss_decision_counts", MATCHES, "select toss_decision, count(winner) as matches from matches where toss_decision is not null group by 1")
oracle("toss_bat_field", MATCHES, """select count(*) filter (toss_decision = 'bat') as bat_first,
  count(*) filter (toss_decision = 'field') as field_first from matches""")
oracle("all_time_wins_top10", MATCHES, "select winner as team, count(*) as wins from matches group by 1 order by 2 desc, 1 limit 10")
oracle("matches_per_season", MATCHES, "select season, count(*) as matches from matches group by 1")
oracle("win_rate_leaderboard", features(), "select team, win_rate from feat order by win_rate desc, team limit 12")
oracle("champions_desc", MATCHES + ",\n" + CHAMPS, "select season, champion from champs order by season desc")
oracle("percent_labels", features(), "select team, " + ", ".join(
    f"printf('%.1f%%', {c} * 100) as {c}_label" for c in ("win_rate", "recent_win_rate", "toss_win_rate", "toss_to_win_rate"))
    + " from feat")

# team features
oracle("team_features_cutoff", features(1999), f"select {FEATURE_LIST} from feat")
oracle("team_match_sides", MATCHES + ",\n" + SIDES, "select match_id, season, winner, team from sides")
oracle("team_win_rate", features(), "select team, win_rate, total_matches from feat")
for key, col in [("team_recent_form", "recent_win_rate"), ("team_titles", "titles"), ("team_toss_rate", "toss_win_rate"),
                 ("team_toss_conversion", "toss_to_win_rate"), ("team_seasons_played", "seasons_played")]:
    oracle(key, features(), f"select team, {col} from feat")
oracle("team_features_rounded", features(), "select team, titles, total_matches, seasons_played, " + ", ".join(
    f"cast(printf('%.4f', {c}) as double) as {c}" for c in ("win_rate", "recent_win_rate", "toss_win_rate", "toss_to_win_rate"))
    + " from feat")
oracle("team_features_all", features(), f"select {FEATURE_LIST} from feat")
oracle("last_n_seasons", MATCHES, "select distinct season from matches order by season desc limit 3")
oracle("team_features_point_in_time", PIT, f"select season, {FEATURE_LIST} from seen")

# head to head
oracle("h2h_win_rate", MATCHES + ",\nt1(o1, team1) as (select * from roster), t2(o2, team2) as (select * from roster)",
       f"select t1.team1, t2.team2, {h2h('t1.team1', 't2.team2')} as t1_h2h_win_rate from t1 join t2 on o1 <> o2")
oracle("h2h_record", MATCHES + ",\nt1(o1, team1) as (select * from roster), t2(o2, team2) as (select * from roster)",
       """select p.team1, p.team2, count(*) filter (m.winner = p.team1) as team1_wins, count(*) filter (m.winner = p.team2) as team2_wins,
  count(m.match_id) as meetings,
  coalesce(count(*) filter (m.winner = p.team1) / nullif(count(m.match_id), 0)::double * 100, 50) as team1_win_pct
  from (select team1, team2 from t1 join t2 on o1 < o2) p
  left join matches m on (m.team1 = p.team1 and m.team2 = p.team2) or (m.team1 = p.team2 and m.team2 = p.team1)
  group by 1, 2""")
oracle("h2h_meetings", MATCHES + ",\n" + RECORDS, "select side_a, side_b, meetings from rec")
oracle("h2h_point_in_time", PIT, """select p.season, p.side_a, p.side_b,
  coalesce(count(*) filter (m.winner = p.side_a) / nullif(count(m.match_id), 0)::double, 0.5) as a_win_rate
  from (select distinct season, least(team1, team2) as side_a, greatest(team1, team2) as side_b from matches) p
  left join matches m on m.season < p.season and least(m.team1, m.team2) = p.side_a and greatest(m.team1, m.team2) = p.side_b
  group by 1, 2, 3""")

# training set
oracle("training_start_season", PIT, """select m.season, count(*) as matches from matches m
  join seen a on a.season = m.season and a.team = m.team1 join seen b on b.season = m.season and b.team = m.team2 group by 1""")
oracle("training_feature_join", TRAINING, """select match_id, season, team1, team2, t1_win_rate, t1_titles, t1_seasons,
  t2_win_rate, t2_titles, t2_seasons from training""")
oracle("training_dropped_new_teams", TRAINING, f"""select match_id, season, team1, team2 from matches
  where season >= {START_SEASON} and match_id not in (select match_id from training)""")
oracle("training_toss_label", MATCHES, """select match_id, cast(coalesce(toss_winner = team1, false) as int) as toss_winner_is_t1,
  cast(coalesce(winner = team1, false) as int) as team1_wins from matches""")
oracle("training_rows", TRAINING, "select * from training")
oracle("training_rows_rounded", PIT + ",\n" + _training(4), "select * from training")
oracle("label_balance", TRAINING, """select count(*) as matches, cast(sum(team1_wins) as bigint) as team1_wins,
  avg(team1_wins) * 100 as team1_win_pct, cast(count(*) - sum(team1_wins) as bigint) as team2_wins,
  (1.0e0 - avg(team1_wins)) * 100 as team2_win_pct from training""")

# model selection and evaluation
INPUTS = [f"t{i}_{c}" for i in (1, 2) for c in ("win_rate", "recent_win_rate", "titles", "toss_win_rate", "toss2win_rate", "seasons")]
oracle("feature_vector", TRAINING, "select match_id, " + ", ".join(
    f"cast({c} as double) as v{i}" for i, c in enumerate([*INPUTS, "toss_winner_is_t1", "t1_h2h_win_rate"])) + " from training")
oracle("stratified_split_counts", SPLIT, "select team1_wins, is_train, count(*) as matches from split group by 1, 2")
oracle("stratified_split", SPLIT, "select match_id, team1_wins, is_train from split")
oracle("stratified_folds", SPLIT, "select match_id, team1_wins, fold from folds")
oracle("season_forward_split", TRAINING, "select season < 2001 as is_train, count(*) as matches from training group by 1")
oracle("accuracy", SPLIT, f"select avg(cast(prediction = team1_wins as int)) as accuracy from {TEST}")
oracle("cv_mean_std", SPLIT, f"""select cast(printf('%.9f', avg(acc)) as double) as cv_mean, cast(printf('%.9f', stddev_pop(acc)) as double) as cv_std
  from (select fold, avg(cast(prediction = team1_wins as int)) as acc from {_guess('folds')} group by fold)""")
oracle("confusion_matrix", SPLIT, f"""select team1_wins as actual, count(*) filter (prediction = 0) as predicted_0,
  count(*) filter (prediction = 1) as predicted_1 from {TEST} group by 1""")
oracle("classification_report", SPLIT, f""", g as (select * from {TEST}),
per as (
  select c as label, count(*) filter (team1_wins = c and prediction = c) / count(*) filter (prediction = c)::double as p,
    count(*) filter (team1_wins = c and prediction = c) / count(*) filter (team1_wins = c)::double as r,
    count(*) filter (team1_wins = c) as s from g, (values (0), (1)) v(c) group by c),
f as (select *, 2.0e0 * p * r / (p + r) as f from per),
a as (select avg(cast(prediction = team1_wins as int)) as acc, count(*) as n from g),
wide as (select z.p as p0, z.r as r0, z.f as f0, z.s as s0, o.p as p1, o.r as r1, o.f as f1, o.s as s1, n, acc
  from f z, f o, a where z.label = 0 and o.label = 1)
select 'Team 2 Wins' as class, p0 as precision, r0 as recall, f0 as f1, s0 as support from wide
union all select 'Team 1 Wins', p1, r1, f1, s1 from wide
union all select 'accuracy', acc, acc, acc, n from wide
union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from wide
union all select 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n from wide""")
oracle("model_comparison", SPLIT, f"""select avg(cast(team1_wins = 1 as int)) as baseline_accuracy,
  avg(cast(prediction = team1_wins as int)) as model_accuracy,
  (avg(cast(prediction = team1_wins as int)) - avg(cast(team1_wins = 1 as int))) * 100 as improvement_points,
  printf('%+.1f%%', (avg(cast(prediction = team1_wins as int)) - avg(cast(team1_wins = 1 as int))) * 100) as improvement from {TEST}""")

# scoring, standings, bracket
SIDE = ", ".join(f"f{i}.{c} as t{i}_{a}" for i in (1, 2) for c, a in [
    ("win_rate", "win_rate"), ("recent_win_rate", "recent_win_rate"), ("titles", "titles"),
    ("toss_win_rate", "toss_win_rate"), ("toss_to_win_rate", "toss2win_rate"), ("seasons_played", "seasons")])
oracle("matchup_features", FORECAST, f"""select o.team1, o.team2, {SIDE}, 0.5e0 as toss_winner_is_t1, o.rate as t1_h2h_win_rate,
  (select count(*) from matches m where least(m.team1, m.team2) = least(o.team1, o.team2)
    and greatest(m.team1, m.team2) = greatest(o.team1, o.team2)) as h2h_meetings
  from ordered o join feat f1 on f1.team = o.team1 join feat f2 on f2.team = o.team2 where ord1 < ord2""")
oracle("match_prediction_toss", FORECAST, f""", toss(t) as (values (0.0e0), (0.5e0), (1.0e0)),
s as (select o.team1, o.team2, t as toss_winner_is_t1, {p1('t')} as p1
  from ordered o join feat f1 on f1.team = o.team1 join feat f2 on f2.team = o.team2, toss where ord1 < ord2)
select team1, team2, toss_winner_is_t1, p1, 1.0e0 - p1 as p2, case when p1 >= 1.0e0 - p1 then team1 else team2 end as predicted_winner,
  greatest(p1, 1.0e0 - p1) as win_probability from s""")
oracle("fixtures_without_features", features(), """select a.team as team1, b.team as team2,
  a.team not in (select team from feat) as team1_missing, b.team not in (select team from feat) as team2_missing
  from roster11 a join roster11 b on a.ord < b.ord
  where a.team not in (select team from feat) or b.team not in (select team from feat)""")
oracle("round_robin_pairs", MATCHES + """, t as (select team, cast(substr(team, 8) as int) as ord
  from (select team1 as team from matches union select team2 from matches))""",
       "select a.team as team1, b.team as team2 from t a join t b on a.ord < b.ord")
oracle("standings_two_leg", FORECAST + ",\n" + standings(), "select rank, team, expected_points from table_")
oracle("standings_single_leg", FORECAST + ",\n" + standings(1), "select rank, team, expected_points from table_")
oracle("standings_qualification", FORECAST + ",\n" + standings(), """select rank, team, rank <= 4 as qualifies,
  case rank when 1 then 'gold' when 2 then 'silver' when 3 then 'bronze' when 4 then 'qualifier' else 'eliminated' end as tier from table_""")
oracle("standings_share_of_max", FORECAST + ",\n" + standings(), """select team, expected_points,
  expected_points / (select max(expected_points) from table_) * 100 as share_of_leader from table_""")
oracle("playoff_cutoff", FORECAST + ",\n" + standings(), "select sum(expected_points) / 2 as cutoff from table_ where rank in (4, 5)")
oracle("matchup_detail", FORECAST, """select concat(team1, '  vs  ', team2) as match,
  case when p1 >= 0.5e0 then team1 else team2 end as predicted_winner, printf('%.1f%%', greatest(p1, 1.0e0 - p1) * 100) as win_probability,
  (select count(*) from matches m where least(m.team1, m.team2) = least(s.team1, s.team2)
    and greatest(m.team1, m.team2) = greatest(s.team1, s.team2)) as h2h_meetings
  from scored s where ord1 < ord2""")
oracle("playoff_seeds", BRACKET, "select * from seed")
oracle("playoff_bracket", BRACKET, "select * from bracket")
oracle("champion_prediction", BRACKET, """select winner as champion, case when winner = t1 then t2 else t1 end as runner_up,
  prob as win_probability from bracket where stage = 'Final'""")
STATS = [("win_rate", "Overall Win Rate"), ("recent_win_rate", "Recent Form (3y)"), ("titles", "Titles"),
         ("toss_to_win_rate", "Win Rate After Toss")]
oracle("team_comparison_pivot", features(), "\nunion all ".join(
    "select '{1}' as stat, max(v) filter (team = 'NATION_7') as \"NATION_7\", max(v) filter (team = 'NATION_21') as \"NATION_21\" "
    "from (select team, {2} as v from feat)".format(c, label, f"cast({c} as string)" if c == "titles" else f"printf('%.1f%%', {c} * 100)")
    for c, label in STATS))
KNOWN = "(select team1 as team from matches union select team2 from matches)"
oracle("league_teams_valid", MATCHES, f"select ord, team from roster11 where team in {KNOWN}")
oracle("league_teams_missing", MATCHES, f"select ord, team from roster11 where team not in {KNOWN}")

# many leagues at once: every step per league
LEAGUES = MATCHES + """,
lchamps as (
  select league, season, winner as champion from (
    select *, row_number() over (partition by league, season order by (stage like '%final%') desc, match_id desc) as rn
    from matches) where rn = 1),
lsides as (
  select league, match_id, season, team1 as team, winner, toss_winner from matches
  union all
  select league, match_id, season, team2 as team, winner, toss_winner from matches where team2 <> team1),
lseas as (
  select league, season, row_number() over (partition by league order by season) as k,
    count(*) over (partition by league) as n from (select distinct league, season from matches)),
lfeat0 as (
  select s.league, s.team, """ + _measures("k.k > k.n - 3") + """
  from lsides s join lseas k on k.season = s.season and k.league = s.league group by s.league, s.team),
lfeat as (
  select f.*, (select count(*) from lchamps c where c.champion = f.team and c.league = f.league) as titles from lfeat0 f)"""
LEAGUE_TRAINING = LEAGUES + """,
seen0 as (
  select n.league, n.season, s.team, """ + _measures("k.k >= n.k - 3") + """
  from lseas n join lsides s on s.season < n.season and s.league = n.league
  join lseas k on k.season = s.season and k.league = s.league
  group by n.league, n.season, s.team),
seen as (
  select f.*, (select count(*) from lchamps c where c.champion = f.team and c.league = f.league and c.season < f.season) as titles
  from seen0 f),
h2h_seen as (
  select p.league, p.season, p.team1, p.team2,
    coalesce(count(*) filter (m.winner = p.team1) / nullif(count(m.match_id), 0)::double, 0.5) as rate
  from (select distinct league, season, team1, team2 from matches) p
  left join matches m on m.season < p.season and m.league = p.league
    and ((m.team1 = p.team1 and m.team2 = p.team2) or (m.team1 = p.team2 and m.team2 = p.team1))
  group by all),
""" + _training().replace("training as (\n  select", "training as (\n  select m.league,").replace(
    "a.season = m.season", "a.league = m.league and a.season = m.season").replace(
    "b.season = m.season", "b.league = m.league and b.season = m.season").replace(
    "h.season = m.season", "h.league = m.league and h.season = m.season")
LEAGUE_TABLE = LEAGUES + """,
lvalid as (select f.league, r.ord, r.team from roster r join lfeat f using (team)),
lordered as (
  select a.league, a.ord as ord1, b.ord as ord2, a.team as team1, b.team as team2,
    coalesce((select count(*) filter (m.winner = a.team) / nullif(count(*), 0)::double from matches m where m.league = a.league
      and ((m.team1 = a.team and m.team2 = b.team) or (m.team1 = b.team and m.team2 = a.team))), 0.5) as rate
  from lvalid a join lvalid b on a.league = b.league and a.ord <> b.ord),
scored as (
  select o.*, """ + p1() + """ as p1 from lordered o
  join lfeat f1 on f1.team = o.team1 and f1.league = o.league join lfeat f2 on f2.team = o.team2 and f2.league = o.league),
points as (
  select league, team, sum(p) as points from (
    select league, team1 as team, 2.0e0 * p1 as p from scored
    union all select league, team2, 2.0e0 * (1.0e0 - p1) from scored) group by league, team),
table_ as (
  select league, cast(row_number() over (partition by league order by pts desc, ord) as int) as rank, team, pts as expected_points
  from (select v.league, v.ord, v.team, cast(printf('%.1f', coalesce(points, 0)) as double) as pts
        from lvalid v left join points using (league, team)))"""
oracle("champions_by_league", LEAGUES, "select league, season, champion from lchamps")
oracle("team_features_by_league", LEAGUES, f"select league, {FEATURE_LIST} from lfeat")
oracle("training_rows_by_league", LEAGUE_TRAINING, "select * from training")
oracle("standings_by_league", LEAGUE_TABLE, """select t.*, rank <= 4 as qualifies,
  case rank when 1 then 'gold' when 2 then 'silver' when 3 then 'bronze' when 4 then 'qualifier' else 'eliminated' end as tier,
  expected_points / max(expected_points) over (partition by league) * 100 as share_of_leader from table_ t""")


def _league_game(no, stage, source):
    return f"""select g.league, {no} as stage_no, '{stage}' as stage, t1, t2, p1,
    case when p1 >= 0.5e0 then t1 else t2 end as winner, case when p1 >= 0.5e0 then t2 else t1 end as loser
  from ({source}) g join scored s on s.league = g.league and s.team1 = t1 and s.team2 = t2"""


oracle("playoff_bracket_by_league", LEAGUE_TABLE + f""",
g1 as ({_league_game(1, 'Qualifier 1', 'select a.league, a.team as t1, b.team as t2 from table_ a join table_ b using (league) where a.rank = 1 and b.rank = 2')}),
g2 as ({_league_game(2, 'Eliminator', 'select a.league, a.team as t1, b.team as t2 from table_ a join table_ b using (league) where a.rank = 3 and b.rank = 4')}),
g3 as ({_league_game(3, 'Qualifier 2', 'select g1.league, g1.loser as t1, g2.winner as t2 from g1 join g2 using (league)')}),
g4 as ({_league_game(4, 'Final', 'select g1.league, g1.winner as t1, g3.winner as t2 from g1 join g3 using (league)')})""",
       """select league, stage_no, stage, t1, t2, winner, greatest(p1, 1.0e0 - p1) as prob
  from (select * from g1 union all select * from g2 union all select * from g3 union all select * from g4)""")

# names
oracle("normalize_team_names", NAMES, "select raw, canonical from named")
oracle("normalize_team_names_or_raw", NAMES, """select endpoint_no, page_no, coalesce(a.canonical, team1) as team1_name,
  coalesce(b.canonical, team2) as team2_name from feed join named a on a.raw = team1 join named b on b.raw = team2""")
oracle("team_dim_lookup", NAMES, """select k.team, arg_min(t.key, t.ord) as key,
  coalesce(arg_min(t.short, t.ord), upper(substr(k.team, 1, 3))) as short, coalesce(arg_min(t.color, t.ord), '#FF6B1A') as color
  from known k left join team_dim t on contains(lower(t.key), lower(k.team)) or contains(lower(k.team), lower(t.key)) group by k.team""")
oracle("resolve_roster", NAMES, """, entries(ord, entry) as (values (1, 'NATION_3'), (2, 'The NATION_1 Club'), (3, 'NATION_3'),
  (4, 'Old NATION_2'), (5, 'Real Madrid'), (6, 'xNATION_7x'), (7, 'NATI')),
word as (select ord, unnest(string_split(entry, ' ')) as w from entries where entry not in (select team from known)),
hit as (
  select ord, entry as team from entries where entry in (select team from known)
  union all
  select ord, min(team) from word join known on contains(team, w) where length(w) > 4 group by ord)
select min(ord) as ord, team from hit group by team""")

# fixture feed
IN_SEASON = f"season_feed as (select * from feed where series like '%{FEED_SEASON}%')"
oracle("feed_season_filter", IN_SEASON, f"select {FEED} from season_feed")
oracle("feed_season_filter_keep_all", "", f"select {FEED} from feed")
oracle("feed_dedup", IN_SEASON, f"select {FEED} from {_dedup('season_feed')}")
oracle("feed_status_buckets", "", """select endpoint_no, page_no, winner <> '' as completed,
  winner = '' and team1 <> '' and team2 <> '' as upcoming, lower(status) like '%live%' or lower(status) like '%innings%' as live from feed""")
oracle("completed_last20", NAMES, f""", last as (select * from {_dedup('feed')} where winner <> ''
  order by endpoint_no desc, page_no desc, item_no desc limit 20),
n(raw, name) as (select raw, coalesce(canonical, raw) from named)
select page_no, a.name as team1_name, b.name as team2_name,
  coalesce((select min(name) from n w where w.raw = winner), winner) as winner_name, date
  from last join n a on a.raw = team1 join n b on b.raw = team2""")
oracle("upcoming_predictions", features() + ",\n" + IN_SEASON + ",\n" + NAMES.replace(MATCHES + ",\n", "") + """,
open_games as (select * from """ + _dedup("season_feed") + """ where winner = '' and team1 <> '' and team2 <> ''),
o as (
  select g.*, a.canonical as n1, b.canonical as n2, """ + h2h("a.canonical", "b.canonical") + """ as rate
  from open_games g join named a on a.raw = g.team1 join named b on b.raw = g.team2),
s as (
  select o.*, f1.team is not null and f2.team is not null as predictable, """ + p1() + """ as p1
  from o left join feat f1 on f1.team = n1 left join feat f2 on f2.team = n2)""",
       """select endpoint_no, page_no, item_no, team1, team2, date, venue,
  case when predictable then n1 end as team1_name, case when predictable then n2 end as team2_name,
  case when predictable then case when p1 >= 1.0e0 - p1 then n1 else n2 end end as favourite,
  case when predictable then greatest(p1, 1.0e0 - p1) end as favourite_prob,
  p1, 1.0e0 - p1 as p2, predictable from s""")
oracle("feed_stream_dedup", "", f"select {FEED} from {_dedup('feed')}")
# "recent" lands after "current"
oracle("feed_stream_state", "", f"select {FEED} from {_dedup('feed')}")
oracle("feed_stream_latest", "", f"select {FEED} from {_dedup('feed').replace('order by endpoint_no,', 'order by endpoint_no desc,')}")
oracle("feed_bad_items", "", """select 'row' as problem, count(*) as n from contest where mid % 11 <> 0
  union all select 'item', count(*) from contest where mid % 11 = 0
  union all select 'page', count(distinct mid // 3) from contest where (mid // 3) % 13 = 0""")

# fitted models: what must hold whatever the fit
oracle("rf_baseline_accuracy", TRAINING, "select cast(ceil(count(*) * 0.2e0) as bigint) as holdout_rows, true as useful from training")
oracle("gbt_accuracy", TRAINING, "select cast(ceil(count(*) * 0.2e0) as bigint) as holdout_rows, true as useful from training")
oracle("fitted_model_comparison", "", "select true as baseline_useful, true as model_useful, true as gain_fits")
oracle("feature_importances", "", "select cast(14 as bigint) as features, true as adds_up, true as none_negative")
TRAIN_ROWS = "cast(count(*) - ceil(count(*) * 0.2e0) as bigint) as train_rows"
oracle("random_search_table", TRAINING, f"""select {TRAIN_ROWS}, cast(5 as bigint) as combinations, cast(5 as bigint) as different,
  true as in_range, true as useful, true as best_chosen from training""")
oracle("refit_best", TRAINING, "select cast(ceil(count(*) * 0.2e0) as bigint) as holdout_rows, 0.0e0 as moved from training")
oracle("cv_fitted_mean_std", TRAINING, f"""select cast(5 as bigint) as folds, {TRAIN_ROWS}, true as mean_fits, true as std_fits, true as useful
  from training""")
oracle("model_roundtrip_score", TRAINING, "select cast(ceil(count(*) * 0.2e0) as bigint) as holdout_rows, 0.0e0 as moved from training")
oracle("stored_model_reused", TRAINING, "select cast(ceil(count(*) * 0.2e0) as bigint) as holdout_rows, cast(1 as int) as trained from training")
oracle("score_fixtures_model", "", "select count(*) as teams, 180.0e0 as points, cast(1 as int) as best, cast(count(*) as int) as last from roster")
oracle("observed_write", TRAINING, """select m.*, t.* from (select count(*) as matches,
  array_to_string(list_sort(list(distinct season)), ',') as seasons from matches) m, (select count(*) as training_rows,
  cast(18 as int) as columns, cast(sum(team1_wins) as bigint) as team1_wins from training) t""")
oracle("training_shape", TRAINING, "select count(*) as rows, cast(18 as int) as columns from training")
oracle("winner_fallback", MATCHES, "select match_id, season, team1, team2, winner from matches")
oracle("all_time_wins_by_league", LEAGUES, """select league, team, wins from (
  select *, row_number() over (partition by league order by wins desc, team) as rn
  from (select league, winner as team, count(*) as wins from matches group by all)) where rn <= 3""")
oracle("leaderboard_by_league", LEAGUES, """select league, team, win_rate from (
  select *, row_number() over (partition by league order by win_rate desc, team) as rn from lfeat) where rn <= 3""")

# a select that starts with "," continues the CTE list
for _name, _sql in ORACLE_SQL.items():
    ORACLE_SQL[_name] = _sql.replace(")\n, ", "),\n", 1) if ")\n, " in _sql else _sql
