import pytest

from furrow.plans import protocols as p


def protocol(**changes):
    return p.Protocol(**{"protocol_id": "x", "coverage_target": "original_field", "reference": p.Reference(1e6, 1e4, 1e6, "declared"), "reverse_cost": p.ReverseCost(1.0, 0.0), **changes})


def test_hashes():
    assert protocol().spec_hash == protocol().spec_hash != protocol(reverse_cost=p.ReverseCost(8.0, 0.0)).spec_hash
    for bad in ({"protocol_id": ""}, {"coverage_threshold": 2.0}):
        with pytest.raises(ValueError):
            protocol(**bad)
    with pytest.raises(ValueError):
        p.ReverseCost(0.5, 0.0)


def test_sampling():
    holes = {f"f{k:02d}": (2 if k < 4 else 1 if k < 12 else 0) for k in range(40)}
    got = p.Sampling().pick(holes)
    assert got == sorted(got) and len(got) == 14 and sum(holes[k] > 0 for k in got) == 6 and sum(holes[k] > 1 for k in got) >= 2
    assert got == p.Sampling().pick(dict(reversed(holes.items()))) and p.request_id(3, "a") == "f2b_003_a"
    with pytest.raises(ValueError):
        p.Sampling(total=2, with_obstacles=3)
    with pytest.raises(ValueError):
        p.Sampling().pick({"a": 0})


def test_seals():
    s = p.Seals()
    s.seal("genesis", {"a": 1})
    with pytest.raises(ValueError, match="comes before"):
        s.seal("cv_result", {})
    first = s.seal("pool_census", {"n": 3})
    assert s.seal("pool_census", {"n": 3}) == first and first["index"] == 1 and first["prev_hash"] == s.log()[0]["entry_hash"]
    with pytest.raises(ValueError, match="another result"):
        s.seal("pool_census", {"n": 4})
    s.require_unsealed("recommender_result")
    with pytest.raises(ValueError):
        s.require_unsealed("genesis")
    assert p.utm_code(9.0, 48.0) == 32632
