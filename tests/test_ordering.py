"""Distributed order statistics against brute force, with one value holding a third of the rows."""

import random

import numpy as np
import pandas as pd
import pytest

from larder.functions import ordering


@pytest.fixture(params=[500_000, 50], ids=["one range", "many ranges"])
def layout(request, monkeypatch):
    monkeypatch.setattr(ordering, "PER_RANGE", request.param)


def skewed(n=3000, seed=1):
    random.seed(seed)
    values = [7.5 if i % 3 == 0 else round(random.uniform(-100, 100), 1) for i in range(n)]
    return [(i, "a" if i % 3 else "b", None if i % 50 == 0 else v) for i, v in enumerate(values)]


def test_percent_rank_is_average_rank(rows):
    df = rows("k int, v double", [(1, 10.0), (2, 10.0), (3, 30.0), (4, 40.0), (5, None)])
    got = {r["k"]: r["p"] for r in ordering.percent_ranks(df, {"p": "v"}).collect()}
    assert got == {1: 0.375, 2: 0.375, 3: 0.75, 4: 1.0, 5: None}


def test_ranks_match_pandas(rows, layout):
    data = skewed()
    df = rows("k int, g string, v double", data)
    frame = pd.DataFrame(data, columns=["k", "g", "v"])
    whole = {r["k"]: r["p"] for r in ordering.percent_ranks(df, {"p": "v"}).collect()}
    scoped = {r["k"]: r["p"] for r in ordering.percent_ranks(df, {"p": "v"}, ["g"]).collect()}
    place = {r["k"]: r["p"] for r in ordering.competition_rank(df, "p", "v").collect()}
    for k, a, b, c in zip(frame.k, frame.v.rank(pct=True), frame.groupby("g").v.rank(pct=True), frame.v.rank(ascending=False, method="min")):
        if pd.isna(a):
            assert whole[k] is None and scoped[k] is None and place[k] is None
        else:
            assert whole[k] == pytest.approx(a) and scoped[k] == pytest.approx(b) and place[k] == c


def test_quantiles_match_numpy(rows, layout):
    data = skewed(seed=2)
    values = [v for _, _, v in data if v is not None]
    df = rows("k int, g string, v double", data)
    got = ordering.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.999}).first()
    assert [got[c] for c in "abcd"] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75, 0.999])))
    per = {r["g"]: r["m"] for r in ordering.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    for g in "ab":
        assert per[g] == pytest.approx(np.median([v for _, h, v in data if h == g and v is not None]))


def test_numbering_is_gapless(rows, layout):
    df = rows("k long, g string", [(i * 3 % 101, "x" if i % 3 else "y") for i in range(101)])
    got = ordering.numbered(df, "n", "k", ["g"]).orderBy("g", "k").collect()
    for g in "xy":
        assert [r["n"] for r in got if r["g"] == g] == list(range(1, sum(r["g"] == g for r in got) + 1))
