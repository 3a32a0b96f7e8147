"""Window detectors with models made for the test."""

import numpy as np
import pytest

from lumaframe.errors import FormatError, ParameterError
from lumaframe.operators import markers, windows

#: One stage, one stump: the left half of the window is darker than the right one.
XML = """<opencv_storage><cascade><stageType>BOOST</stageType><featureType>HAAR</featureType><height>12</height><width>12</width>
<stages><_><stageThreshold>0.5</stageThreshold><weakClassifiers><_><internalNodes>0 -1 0 0.25</internalNodes><leafValues>0. 1.</leafValues></_></weakClassifiers></_></stages>
<features><_><rects><_>0 0 12 12 -1.</_><_>6 0 6 12 2.</_></rects><tilted>0</tilted></_></features></cascade></opencv_storage>"""


def scene(x, y, size=12, shape=(60, 80)):
    img = np.full(shape, 128, np.uint8)
    img[y : y + size, x : x + size // 2], img[y : y + size, x + size // 2 : x + size] = 20, 230
    return img


def test_cascade_against_every_window():
    cascade = windows.load_cascade(XML.replace("0.25", "0.1"))
    img = np.random.default_rng(0).integers(0, 256, (30, 34)).astype(np.uint8)
    got = {tuple(p) for p in windows.passing(img, cascade, 1).tolist()}
    want = set()
    for y in range(30 - 11):
        for x in range(34 - 11):
            w = img[y : y + 12, x : x + 12].astype(float)
            inner = w[1:-1, 1:-1]
            norm = np.sqrt(inner.size * (inner**2).sum() - inner.sum() ** 2)
            if (2 * w[:, 6:].sum() - w.sum()) / norm >= 0.1:
                want.add((x, y))
    assert got == want and 0 < len(want) < 437


def test_cascade_finds_what_it_is_made_for():
    cascade = windows.load_cascade(XML)
    found = windows.detect_haar(scene(30, 20), cascade, 1.2, 1)
    best = max(found, key=lambda b: min(b[0] + b[2], 42) - max(b[0], 30))
    assert abs(best[0] + best[2] / 2 - 36) <= 4 and abs(best[1] + best[3] / 2 - 26) <= 8
    assert windows.detect_haar(np.full((40, 40), 90, np.uint8), cascade) == []
    assert all(w >= 20 for *_, w, _ in windows.detect_haar(scene(10, 10, 24), cascade, 1.2, 0, (20, 20)))
    for wrong in ({"scale_factor": 1.0}, {"min_neighbors": -1}):
        with pytest.raises(ParameterError):
            windows.detect_haar(scene(3, 3), cascade, **wrong)
    with pytest.raises(FormatError):
        windows.load_cascade("<a></a>")


def test_gradient_histograms():
    img = np.random.default_rng(1).integers(0, 256, (32, 24)).astype(np.uint8)
    cells = windows.gradient_cells(img)
    a = np.pad(img.astype(float), 1, mode="edge")
    size = np.hypot(a[1:-1, 2:] - a[1:-1, :-2], a[2:, 1:-1] - a[:-2, 1:-1])
    assert np.allclose(cells.sum(2), size.reshape(4, 8, 3, 8).sum((1, 3)))
    assert windows.hog_descriptor(img).shape == (3 * 2 * 36,)
    blocks = windows.gradient_blocks(img)
    assert np.allclose((blocks**2).sum(2), 1, atol=1e-3)


def test_hog_finds_the_pattern_it_has_weights_for():
    rng = np.random.default_rng(2)
    person = np.kron(rng.integers(0, 2, (8, 4)) * 200, np.ones((4, 4))).astype(np.uint8)
    img = np.full((80, 96), 60, np.uint8)
    img[24:56, 40:56] = person
    d = windows.hog_descriptor(person)
    found = windows.detect_hog(img, np.append(d - 0.1, -0.4 * float(d @ d)), (16, 32), 1.5)
    assert found and found[0]["label"] == "person" and abs(found[0]["x"] - 40) <= 8 and abs(found[0]["y"] - 24) <= 8 and 0.5 < found[0]["confidence"] < 1
    for wrong in ({"scale": 1.0}, {"svm": [1.0]}):
        with pytest.raises(ParameterError):
            windows.detect_hog(**{"img": img, "svm": d, "window": (16, 32)} | wrong)


def test_drawn_markers_keep_the_rest():
    img = np.zeros((64, 64, 3), np.uint8)
    out = markers.draw_markers(img, [(3, np.array([[10.0, 10], [40, 10], [40, 40], [10, 40]]))])
    assert out[10, 20, 1] > 200 and out[25, 40, 1] > 200 and (out[50:, 50:] == 0).all() and out[20:32, 22:40].any()
