"""From a matches table and a roster to standings, bracket and champion."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators.bracket import champion_prediction, playoff_bracket
from ..operators.explore import champions
from ..operators.facts import duel_facts, pair_season_facts, season_index, team_season_facts
from ..operators.scoring import scored_detail
from ..operators.standings import (
    expected_points, score_round_robin, standings, teams_present, with_qualification,
    with_share_of_leader,
)
from ..operators.team_features import team_features_from_facts
from ..session import materialize


@dataclass
class History:
    """What scoring needs of the past: team features and pair records."""
    features: DataFrame
    records: DataFrame


def history(matches: DataFrame, keys=()) -> History:
    """Features and records from one pass over the matches (and one for champions)."""
    duels = materialize(duel_facts(matches, keys), "duels")
    facts = team_season_facts(duels, champions(matches, keys), keys)
    features = team_features_from_facts(facts, season_index(duels, keys), keys)
    records = pair_season_facts(duels, keys).groupBy(*keys, "side_a", "side_b").sum("meetings", "a_wins", "b_wins")
    records = records.withColumnsRenamed({f"sum({c})": c for c in ("meetings", "a_wins", "b_wins")})
    return History(materialize(features, "features"), materialize(records, "records"))


class Forecast:
    """Season forecast of every league in ``roster(ord, team)``; frames are planned
    when asked for.

    The scored round robin is stored once; standings and bracket both read it.
    """

    def __init__(self, past: History, roster: DataFrame, scorer, legs=2, keys=()):
        self._keys = keys
        valid = teams_present(roster, past.features, keys)
        self.scored = materialize(
            score_round_robin(valid, past.features, past.records, scorer, keys), "round-robin")
        self.standings = standings(expected_points(valid, self.scored, legs, keys), keys)

    @cached_property
    def table(self) -> DataFrame:
        return with_share_of_leader(with_qualification(self.standings), self._keys)

    @cached_property
    def detail(self) -> DataFrame:
        return scored_detail(self.scored.where("leg = 1"), self._keys)

    @cached_property
    def bracket(self) -> DataFrame:
        return playoff_bracket(self.standings, self.scored, self._keys)

    @cached_property
    def champion(self) -> DataFrame:
        return champion_prediction(self.bracket, self._keys)


def forecast(past: History, roster: DataFrame, scorer, legs=2, keys=()) -> Forecast:
    return Forecast(past, roster, scorer, legs, keys)
