"""Pictures of many boxes at once against pictures that are painted one by one, and their files."""

import numpy as np
import pyarrow as pa
import pytest
from test_pictures_many import drawings

from roomwright.operators import kernel
from roomwright.sources import png


@pytest.mark.parametrize(("longest", "stroke"), [(200, 2), (64, 1)])
def test_files_hold_what_is_painted(monkeypatch, longest, stroke):
    draw = np.random.default_rng(longest)
    made = list(drawings(40, longest))
    boxes = np.array([(*s.reshape(-1, 2).min(axis=0), *s.reshape(-1, 2).max(axis=0)) for s in made])
    boxes[::4] += (0.7, 0.4, -0.1, -0.3)  # crops
    rings, colours, room_of = [], [], []
    for k in range(len(made)):
        for _ in range(draw.integers(0, 4)):
            (x, y), (w, h) = boxes[k, :2] + draw.random(2) * 3, draw.random(2) * 4
            rings.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if draw.integers(6) else [(x, y), (x + w, y), (x, y + h)])
            colours.append(f"#{draw.integers(1 << 24):06x}")
            room_of.append(k)
    column = pa.array([[{"x": x, "y": y} for x, y in r] for r in rings])
    want = [png.paint(tuple(boxes[k]), [(np.array(rings[r]), colours[r]) for r in range(len(rings)) if room_of[r] == k], made[k], longest, stroke) for k in range(len(made))]
    painted, plain = [], png.paint
    monkeypatch.setattr(png, "paint", lambda *a: painted.append(1) or plain(*a))
    wall_of = np.repeat(np.arange(len(made)), [len(s) for s in made])
    walls = np.concatenate(made)
    near = (np.maximum(walls[:, :2], walls[:, 2:]) >= boxes[wall_of, :2]).all(axis=1) & (np.minimum(walls[:, :2], walls[:, 2:]) <= boxes[wall_of, 2:]).all(axis=1)
    width, height, files = png._pictures(boxes, kernel.Rings(column), colours, np.array(room_of), walls[near], wall_of[near], longest, stroke)
    assert (width, height) == ([w.shape[1] for w in want], [w.shape[0] for w in want])
    assert all(np.array_equal(png.decode(f), w) for f, w in zip(files, want))
    assert len(painted) < 25


def test_a_wall_has_no_holes():
    image = png.paint((0.0, 0.0, 10.0, 10.0), [], np.array([[1.0, 0.31, 1.0, 9.73]]), 97, 1)
    column = (image == 0).all(axis=2).any(axis=1)
    assert np.diff(np.flatnonzero(column)).max() == 1


@pytest.mark.parametrize("indexed", [False, True])
def test_colours_of_single_pixels(indexed):
    rows = np.array([[0, 0, 1, 2], [0, 2, 1, 0]], np.uint8)
    palette = bytes(range(10, 19))
    image = np.frombuffer(palette, np.uint8).reshape(3, 3)[rows[:, 1:]]
    data = png.encode_indexed(rows, palette) if indexed else png.encode(image)
    assert np.array_equal(png.decode(data), image)
    assert png.colours_at(data, [(0.0, 0.0), (1.0, 1.0), (0.5, 1.0)]) == ["#101112", "#101112", "#0d0e0f"]
