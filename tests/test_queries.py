"""Each query against its SQL on the smallest tables."""

import numpy as np
import pytest
from parity import connect, rows

from strideloom.ml import contact_lstm, forward, training
from strideloom.operators import sets
from strideloom.plans import bindings
from strideloom.plans.learned import LEARNED, fixed_network
from strideloom.plans.learned_sql import LEARNED_SQL
from strideloom.plans.queries import FEATURES, QUERIES, cycle_tensor
from strideloom.plans.sql import SQL
from strideloom.plans.store_queries import STORE_QUERIES
from strideloom.plans.store_sql import STORE_SQL
from strideloom.schemas import STRIKE_METRICS

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(STORE_QUERIES) == set(STORE_SQL) and set(LEARNED_SQL) < set(LEARNED)


@pytest.mark.parametrize("name", sorted(SQL | STORE_SQL | LEARNED_SQL))
def test_parity(spark, name):
    got, want = (QUERIES | STORE_QUERIES | LEARNED)[name](spark, SF).toPandas(), connect(SF).sql((SQL | STORE_SQL | LEARNED_SQL)[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["cycle_tensor", "masked_bce"])
def test_events_are_read_once(spark, name):
    """What a query needs more than once is written first, so its own plan has no scan of the events."""
    files = QUERIES[name](spark, SF).inputFiles()
    assert files and not any("events.parquet" in f for f in files)
    assert any("events.parquet" in f for f in QUERIES["gait_cycles"](spark, SF).inputFiles())


@pytest.mark.parametrize("name", ["strike_type_lr", "strike_type_rf", "overstride_window"])
def test_learned(spark, name):
    """A prediction for each held-out strike that has its features, and for no other."""
    d = "/root/testdata/sf0.01"
    strikes = sets.test_split(bindings.strikes(spark, d), bindings.test_videos(spark))
    if name == "overstride_window":
        want = {(r.video, r.side, r.frame) for r in strikes.filter("overstriding <> 'skip'").collect()}
        got = LEARNED[name](spark, d).collect()
        assert {(r.video, r.side, r.strike_frame) for r in got} == want and {r.label for r in got} == {0, 1}
    else:
        features = QUERIES["strike_features"](spark, d).na.drop("any", subset=list(STRIKE_METRICS))
        want = {(r.video, r.side, r.frame) for r in sets.test_split(features, bindings.test_videos(spark)).collect()}
        got = LEARNED[name](spark, d).collect()
        assert {(r.video, r.side, r.frame) for r in got} == want
    assert want and len(got) == len(want) and {r.pred for r in got} <= {0, 1, 2}


def test_reports_of_models(spark):
    got = LEARNED["strike_type_report"](spark, "/root/testdata/sf0.01").collect()
    assert {r.model for r in got} == {"lr", "rf"} and len({r.support for r in got if r["class"] == "accuracy"}) == 1


def test_overstride_report(spark, monkeypatch):
    """Three models on the same held-out strikes."""
    monkeypatch.setattr(training.train, "__defaults__", (2, training.RATE))
    got = LEARNED["overstride_report"](spark, "/root/testdata/sf0.01").collect()
    assert {r.model for r in got} == {"lstm", "lr", "rf"} and len({r.support for r in got if r["class"] == "accuracy"}) == 1


def test_training_is_that_of_one_process(spark):
    """The summed gradient over all cycles, and some epochs of it, are those of a single array; the queries run the reference's 100 epochs."""
    cycles = sets.train_split(cycle_tensor(spark, SF), bindings.test_videos(spark))
    x, y, mask = contact_lstm.tensors(cycles, FEATURES)
    data = training.sequences(cycles, contact_lstm.CYCLE, FEATURES)
    assert data.count() == len(x) and training.train.__defaults__ == (100, training.RATE)
    one, many = contact_lstm.ContactLstm(len(FEATURES)), contact_lstm.ContactLstm(len(FEATURES))
    want, got = one.loss(x, y, mask, 2.0), training.whole_gradient(data, many, FEATURES, 2.0)
    assert got[0] == pytest.approx(want[0], rel=1e-5)
    for k in want[1]:
        assert np.allclose(got[1][k], want[1][k], rtol=1e-3, atol=1e-6)
    losses = training.train(data, many, FEATURES, epochs=4)
    assert losses == pytest.approx(one.fit(x, y, mask, epochs=4, rate=training.RATE, batch=len(x)), rel=1e-3) and losses[-1] < losses[0]


def test_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(training, "FAN", 2)
    cycles = cycle_tensor(spark, SF)
    model = contact_lstm.ContactLstm(len(FEATURES), 4)
    x, y, mask = contact_lstm.tensors(cycles, FEATURES)
    loss, _ = training.whole_gradient(training.sequences(cycles, contact_lstm.CYCLE, FEATURES).repartition(7), model, FEATURES, 1.0)
    assert loss == pytest.approx(model.loss(x, y, mask, 1.0)[0], rel=1e-5)


def test_forward_pass_is_that_of_the_network(spark):
    cycles = cycle_tensor(spark, SF)
    key = lambda r: (r.video, r.side, r.start_frame, r.t)
    want = {key(r): r.logit for r in contact_lstm.predict(cycles, fixed_network(), FEATURES).collect()}
    got = {key(r): r.logit for r in forward.logits(cycles, fixed_network(), FEATURES).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_row_counts(spark):
    """Regression counts at the smallest scale: emitted strikes, with toe-off, cycles kept."""
    s = QUERIES["label_fsm"](spark, SF)
    assert (s.count(), s.filter("u_frame is not null").count(), QUERIES["gait_cycles"](spark, SF).count()) == (163, 79, 38)
