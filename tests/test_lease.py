"""One run at a time."""

import threading

import pytest

from firegrid.sources.sinks import Busy, exclusive


def test_exactly_one_of_two_runs(spark, tmp_path):
    folder, clock = str(tmp_path / "lease"), [100.0]
    now = lambda: clock[0]
    with exclusive(spark, folder, "a", 60, now) as extend:
        with pytest.raises(Busy, match="a holds"), exclusive(spark, folder, "b", 60, now):
            pass
        clock[0] = 150.0
        extend()
        clock[0] = 200.0  # beyond the first term, within the second
        with pytest.raises(Busy), exclusive(spark, folder, "b", 60, now):
            pass
    with exclusive(spark, folder, "b", 60, now):
        pass


def test_a_dead_owners_lease_expires(spark, tmp_path):
    folder, clock = str(tmp_path / "lease"), [100.0]
    now = lambda: clock[0]
    dead = exclusive(spark, folder, "dead", 60, now)
    extend = dead.__enter__()
    clock[0] = 161.0
    with exclusive(spark, folder, "heir", 60, now), pytest.raises(Busy, match="lost"):
        extend()
    dead.__exit__(None, None, None)  # it gives nothing back that it no longer holds
    with pytest.raises(ValueError), exclusive(spark, folder, "fails", 60, now):
        raise ValueError
    with exclusive(spark, folder, "next", 60, now):
        pass


def test_many_callers_at_once(spark, tmp_path):
    won, lost, gate = [], [], threading.Barrier(4)
    inside = threading.Event()

    def run(name):
        gate.wait()
        try:
            with exclusive(spark, str(tmp_path / "lease"), name, 600):
                won.append(name)
                inside.wait(20)
        except Busy:
            lost.append(name)
            if len(lost) == 3:
                inside.set()

    threads = [threading.Thread(target=run, args=(f"r{k}",)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert len(won) >= 1 and len(won) + len(lost) == 4 and len(lost) >= 2
