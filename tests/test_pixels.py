import numpy as np
from lumisift.functions import pixels


def gray(a):
    return np.array(a, np.uint8)[None]


def test_laplacian():
    assert not pixels.laplacian(np.full((1, 10, 10), 128, np.uint8)).any()
    dot = np.zeros((1, 5, 5), np.uint8)
    dot[0, 2, 2] = 255
    assert pixels.laplacian(dot)[0, 2, 2] != 0
    lap = pixels.laplacian(gray([[0, 0, 0], [0, 255, 0], [0, 0, 0]]))[0]
    assert lap.tolist() == [[0, 255, 0], [255, -1020, 255], [0, 255, 0]]


def test_crops():
    a = np.arange(200, dtype=np.uint8).reshape(1, 20, 10)
    assert pixels.center_crop(a, 1.0) is a
    assert pixels.center_crop(a, 0.5).shape == (1, 10, 5)
    assert pixels.crop(a, 50, -3, 9, 99).shape == (1, 20, 1)
    assert pixels.face_crop(a, (2, 2, 4, 4)).shape == (1, 3, 3)
    assert pixels.face_crop(a, (9.9, 19.9, 9.9, 19.9)).shape == (1, 1, 1)


def test_gray_and_resize():
    assert (pixels.to_gray(np.full((1, 2, 2, 3), 255, np.uint8)) == 255).all()
    flat = np.broadcast_to(np.array([10, 20, 30], np.uint8), (1, 30, 40, 3))
    assert (pixels.resize_triangle(flat, 7, 5) == [10, 20, 30]).all()
    y, x = np.mgrid[0:300, 0:400]
    checker = np.repeat((((x + y) % 2) * 255).astype(np.uint8)[None, ..., None], 3, 3)
    small = pixels.resize_triangle(checker, 40, 30)
    assert small.shape == (1, 30, 40, 3) and small.min() >= 100 and small.max() <= 155
    assert pixels.resize_triangle(flat, 80, 60).shape == (1, 60, 80, 3)


def test_fit_size():
    assert pixels.fit_size(100, 50, 220) == (100, 50)
    assert pixels.fit_size(3200, 1000, 1600) == (1600, 500)
    assert pixels.fit_size(100000, 1, 220) == (220, 1)


def test_orientation():
    a = np.arange(6, dtype=np.uint8).reshape(1, 2, 3, 1)
    found = {k: pixels.orient(a, k)[0, ..., 0].tolist() for k in range(1, 9)}
    assert found == {
        1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]],
        5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]],
    }


def test_dhash_flat_is_zero_and_uses_the_sign_bit():
    assert pixels.dhash64(np.full((1, 8, 8, 3), 9, np.uint8))[0] == 0
    falling = np.repeat(np.broadcast_to(np.arange(240, 0, -30, dtype=np.uint8), (1, 8, 8))[..., None], 3, 3)
    assert pixels.dhash64(falling)[0] == -1


def test_moments_of_a_pixel():
    m = pixels.moments(np.array([[[[200, 100, 0]]]], np.uint8))
    assert m["n_px"][0] == 1 and m["sum_rg"][0] == 100 and m["sum_yb2x"][0] == 300 and m["var_full"][0] == 0


def test_detector_tensor():
    assert pixels.detector_tensor(np.zeros((1, 3, 3, 3), np.uint8)).shape == (1, 3, 240, 320)
