"""Random leagues and row-loop versions of the features, for comparison only."""

import random

MATCH = """match_id bigint, season int, team1 string, team2 string, winner string, toss_winner string,
    toss_decision string, venue string, city string, stage string"""


def random_matches(seed, n=160, teams=6, seasons=(2001, 2002, 2004, 2005, 2009)):
    """Seasons with gaps, teams that miss seasons, self-matches, odd winners."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        season = rng.choice(seasons)
        # later teams enter late, the first pauses in between
        names = [f"T{k}" for k in range(teams) if not (k >= 4 and season < 2004) and not (k == 0 and season == 2004)]
        t1, t2 = rng.choice(names), rng.choice(names)
        winner = rng.choice([t1, t1, t2, t2, f"T{rng.randrange(teams)}"])
        toss = rng.choice([t1, t2, None])
        stage = rng.choice(["league"] * 8 + ["semi final", "final", None])
        out.append((1000 + i, season, t1, t2, winner, toss, rng.choice(["bat", "field"]), "v", "c", stage))
    rng.shuffle(out)
    return out


def champion_loop(matches):
    found = {}
    for season in sorted({m[1] for m in matches}):
        games = sorted((m for m in matches if m[1] == season), key=lambda m: m[0])
        finals = [m for m in games if m[9] and "final" in m[9]]
        found[season] = (finals or games)[-1][4]
    return found


def features_loop(matches, cutoff=None):
    past = [m for m in matches if cutoff is None or m[1] < cutoff]
    champs = champion_loop(past)
    recent = sorted({m[1] for m in past})[-3:]
    found = {}
    for team in {m[2] for m in past} | {m[3] for m in past}:
        own = [m for m in past if team in (m[2], m[3])]
        late = [m for m in own if m[1] in recent]
        toss = [m for m in own if m[5] == team]
        found[team] = (
            sum(m[4] == team for m in own) / len(own),
            sum(m[4] == team for m in late) / len(late) if late else 0.0,
            sum(c == team for c in champs.values()),
            len(toss) / len(own),
            sum(m[4] == team for m in toss) / len(toss) if toss else 0.0,
            len(own),
            len({m[1] for m in own}),
        )
    return found


def h2h_loop(matches, t1, t2):
    met = [m for m in matches if (m[2], m[3]) in ((t1, t2), (t2, t1))]
    return sum(m[4] == t1 for m in met) / len(met) if met else 0.5


def training_loop(matches, start):
    out = []
    for season in sorted({m[1] for m in matches}):
        past = [m for m in matches if m[1] < season]
        if season < start or not past:
            continue
        feats = features_loop(matches, season)
        for m in matches:
            if m[1] != season or m[2] not in feats or m[3] not in feats:
                continue
            a, b = feats[m[2]], feats[m[3]]
            out.append((*a[:5], a[6], *b[:5], b[6], int(m[5] == m[2]), h2h_loop(past, m[2], m[3]),
                        int(m[4] == m[2]), m[2], m[3], season, m[0]))
    return sorted(out, key=repr)
