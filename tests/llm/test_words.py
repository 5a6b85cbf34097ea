import numpy as np

from weekrank.llm import words

MOD = 1 << 64


def plain(values, start, end, base):
    total = sum((int(v) + 1) * pow(int(base), i, MOD) for i, v in enumerate(values[start:end]))
    return words.mix(np.array([(total + int(end - start)) % MOD], np.uint64))[0]


def test_windows_of_long_inputs_have_the_hashes_of_their_values():
    rng = np.random.default_rng(2)
    for n in (10, 131_072, 131_073, 300_000):
        values = rng.integers(0, 256, n).astype(np.uint8)
        starts = np.sort(rng.integers(0, n, 5000))
        ends = np.minimum(n, starts + rng.integers(0, 300, 5000))
        by = rng.permutation(5000)
        got = words.window_hashes(values, starts, ends, words.BASE)
        assert (words.window_hashes(values, starts[by], ends[by], words.BASE) == got[by]).all()  # in no order
        for i in rng.integers(0, 5000, 30):
            assert got[i] == plain(values, starts[i], ends[i], words.BASE)
        # Rows of any length, empty ones too, and windows longer than a block.
        at = np.sort(np.concatenate([[0, n, n], rng.integers(0, n, 5)]))
        long = np.arange(0, n // 2 + 1, 997)
        for a, b in ((at[:-1], at[1:]), (long, long + n // 2)):
            got = words.window_hashes(values, a, b, words.GRAM)
            assert all(got[i] == plain(values, a[i], b[i], words.GRAM) for i in (0, len(a) - 1) if b[i] - a[i] < 160_000)
            assert (got == words._window_hashes(values, a, b, words.GRAM)).all()


def test_a_worker_keeps_short_tables_of_powers_only():
    values = np.random.default_rng(3).integers(0, 256, 2_000_000).astype(np.uint8)
    words.grams(values, np.array([0, 1_000_000, 2_000_000]), 32)
    words.hashed(values, np.array([0, 2_000_000]), True)
    assert sum(table.nbytes for pair in words._POWERS.values() for table in pair) < 20_000_000


def test_windows_of_one_size_have_the_hashes_of_their_values():
    rng = np.random.default_rng(4)
    for n, kind in ((0, np.uint8), (5, np.uint8), (40_000, np.uint8), (40_000, np.uint64)):
        values = rng.integers(0, 256, n).astype(kind) * kind(1 if kind is np.uint8 else 0x0123456789ABCDEF)
        for length in (1, 5, 10, 32, 33, 63):
            starts = np.arange(max(n - length + 1, 0))
            assert (words.sized_hashes(values, length, words.GRAM) == words.window_hashes(values, starts, starts + length, words.GRAM)).all()
    # Windows that reach into the next row are left out; rows may be empty or shorter than a window.
    at = np.array([0, 0, 3, 10, 10, 40, 41])
    starts, hashes = words.grams(values, at, 7)
    assert starts.tolist() == [3, *range(10, 34)] and len(hashes) == len(starts)


def test_minima_of_windows_of_any_size():
    values = np.random.default_rng(5).integers(0, 50, 300).astype(np.uint64)
    for width in (1, 2, 3, 64, 69, 299, 300, 301):
        assert words.sliding_min(values, width).tolist() == [values[i:i + width].min() for i in range(300 - width + 1)]
