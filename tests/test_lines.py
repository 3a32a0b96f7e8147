"""Line segments where a few strong lines fill thousands of cells of the accumulator."""

import numpy as np

from lumaframe.operators.detect import hough_lines_p


def test_short_lines_beside_a_large_block_are_found():
    img = np.zeros((200, 260), np.uint8)
    img[20:140, 20:140] = 255
    img[170, 180:245] = 255
    found = hough_lines_p(img, votes=50, length=50, gap=2)
    assert any(a[1] == a[3] == 170 and {a[0], a[2]} == {180, 244} for a in found)


def test_lines_among_noise():
    rng = np.random.default_rng(0)
    img = np.where(rng.random((60, 80)) < 0.03, 255, 0).astype(np.uint8)
    img[10, 5:70] = img[5:55, 40] = 255
    found = hough_lines_p(img, votes=30, length=30, gap=3)
    assert any(a[1] == a[3] == 10 for a in found) and any(a[0] == a[2] == 40 for a in found)
