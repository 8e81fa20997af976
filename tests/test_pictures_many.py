"""Pictures of many drawings at once against pictures that are painted one by one."""

import numpy as np
import pytest

from roomwright.operators import raster


def drawings(count, seed):
    """Walls along the axes with gaps, stubs and nested boxes; every seventh drawing has a slanted wall."""
    draw = np.random.default_rng(seed)
    for k in range(count):
        w, h = draw.integers(1, 30), draw.integers(1, 12)
        walls = [(0, 0, w, 0), (0, h, w, h), (0, 0, 0, h), (w, 0, w, h)]
        for _ in range(draw.integers(0, 9)):
            x, y, size = draw.integers(0, w + 1), draw.integers(0, h + 1), draw.choice([0.0, 0.3, 1.0, 2.5, 8.0])
            walls.append((x, y, x + size, y) if draw.integers(2) else (x, y + size, x, y))
        x, y = draw.random(2) * (w, h) / 2
        walls += [(x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)] if k % 3 == 0 else []
        walls += [(0, 0, w / 2, h / 3)] if k % 7 == 0 else []
        yield np.array(walls, float)[draw.permutation(len(walls))] + draw.random() * 9 - 3


@pytest.mark.parametrize(("longest", "stroke", "pad"), [(256, 2, True), (256, 2, False), (192, 1, True), (300, 3, False)])
def test_pictures_of_many_drawings_equal_painted_ones(monkeypatch, longest, stroke, pad):
    made = list(drawings(80, longest + stroke))
    want = [(k, ring, area) for k, s in enumerate(made) for ring, area in raster.picture_rooms(s, longest, stroke, 0.5, pad)]
    owner = np.repeat(np.arange(len(made)), [len(s) for s in made])
    painted = []
    plain = raster.picture_rooms
    monkeypatch.setattr(raster, "picture_rooms", lambda s, *more: painted.append(len(s)) or plain(s, *more))
    who, rings, area = raster.picture_rooms_many(owner, np.concatenate(made), longest, stroke, np.full(len(made), 0.5), pad, cells_at_once=20_000)
    got = [(k, [(p["x"], p["y"]) for p in ring], a) for k, ring, a in zip(who.tolist(), rings.to_pylist(), area.tolist())]
    assert got == want and len(want) > 80
    assert len(painted) < 30  # most all come without painting
