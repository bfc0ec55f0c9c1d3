"""What larger tables need: small plans, cheap passes over ordinary features."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyze.config import Options
from parcelyze.functions import planar
from parcelyze.operators import feature_checks as checks
from parcelyze.plans import catalogue, lattice
from parcelyze.plans.dry_run import dry_run
from parcelyze.plans.heal import heal


def test_a_dry_runs_findings_are_written_check_by_check(spark, tiny, monkeypatch):
    """One plan of all checks grows the driver with each stage: what is numbered must read tables, not join."""
    from parcelyze.plans import dry_run as module

    plans = []

    def numbered(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.withColumn(rest[-1], F.lit(0).cast("long"))

    monkeypatch.setattr(module, "numbered", numbered)
    dry_run(lattice.features_json(spark, tiny).where("feature_index < 20"), Options())
    assert plans and not re.search("Join|MapInPandas|MapInArrow", plans[0])


@pytest.mark.parametrize("size", [1e-8, 1e-4, 0.01, 1.0])
def test_blunt_corners_are_no_spikes(size):
    """The rough measure lets no corner through that the exact one calls a spike."""
    rng = np.random.default_rng(7)
    for _ in range(400):
        x, y, turn, ratio = rng.uniform(-179, 179), rng.uniform(-84, 84), rng.uniform(0, 6.28), 10 ** rng.uniform(-2, 2)
        tip = [x + size * np.cos(turn), y + size * np.sin(turn)]
        n = [x - size / ratio * np.sin(turn), y + size / ratio * np.cos(turn)]
        before, after, base = (float(planar.haversine(a, b)) for a, b in (([x, y], tip), (tip, n), ([x, y], n)))
        if checks._blunt([x, y], tip, n):
            assert min(before, after) < 3 * base


def test_ordinary_parcels_need_no_exact_crossings(monkeypatch):
    """A rectangle is found simple by its segments' boxes, and its ordinates by themselves; both took most of the pass."""
    called = []
    for module, name in ((planar, "meetings"), (checks, "decimal_places")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real: called.append(1) or real(*a))
    ring = [[51.0, 35.0], [51.001, 35.0], [51.001, 35.001], [51.0, 35.001], [51.0, 35.0]]
    found, _ = checks.check_feature({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}, Options())
    assert not found and not called
    assert planar.ring_crossings([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]) == [(0, 2, "Crossing", [[0.5, 0.5]])]


def test_overlays_of_few_edges_are_plain_and_equal(monkeypatch):
    """Calls of numpy took most of an overlay of two parcels; without them the result is the same, bit by bit."""
    rng = np.random.default_rng(11)

    def polygon():
        points = (rng.integers(0, 8, (rng.integers(3, 7), 2)) * 1e-4 + [51.0, 35.0]).tolist()
        return [[*points, points[0]]]

    cases = [([polygon()], [polygon()], op) for op in ("intersection", "union", "difference", "xor") for _ in range(60)]
    with monkeypatch.context() as m:
        m.setattr(planar, "crossing", None)
        plain = [planar.overlay(*case) for case in cases]
    monkeypatch.setattr(planar, "_PLAIN", 0)
    assert plain == [planar.overlay(*case) for case in cases]


def test_a_heals_dry_run_is_kept_for_the_reports(spark, tiny, monkeypatch):
    """Healing ran all checks, and each first report of the session after it ran them again: minutes at 1,200,000 parcels."""
    made = []
    monkeypatch.setattr(catalogue, "_kept", {})
    monkeypatch.setattr(catalogue, "dry_run", lambda *a: made.append(a) or f"report {len(made)}")
    monkeypatch.setattr(catalogue, "heal", lambda *a, report=None: f"healed by {report}")
    assert catalogue._lattice_healed(spark, tiny, again=True) == "healed by report 1"
    assert catalogue._lattice_run(spark, tiny) == "report 1"
    assert catalogue._lattice_healed(spark, tiny, again=True) == "healed by report 2"  # its checks are always made anew


def test_a_given_report_is_healed_by(spark, tiny):
    class Report:
        @property
        def issues(self):
            raise KeyError("read")

    with pytest.raises(KeyError, match="read"):
        heal(lattice.features_json(spark, tiny).where("feature_index < 20"), Options(), report=Report())
