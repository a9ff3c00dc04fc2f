"""Scoring of texts against a plain loop over their characters."""

import numpy as np
import pytest

from docloom.llm import kneser_ney as kn


class Known:
    """Two of three keys have a value, so has the empty n-gram of languages that have a model; those of other languages have none."""

    def __init__(self, base, none):
        self.base, self.none = base, int(kn.lang_seed(none)) >> 52

    def value(self, key: int) -> float:
        if key in self.base:
            return self.base[key]
        if (key >> 52) & 0xFFF == self.none:
            return float("nan")
        return -(key % 1000) / 100 if key % 3 else float("nan")

    def values(self, keys):
        return np.array([self.value(int(k)) for k in keys], np.float32)


def plain_score(text: str, lang: str, model: Known) -> float:
    s, total = f"{kn.START} {text} ", 0.0
    key = lambda g, kind: int(kn.gram_keys([lang], [g], kind)[0])
    for p in range(2, len(s)) if text else ():
        for n in range(kn.ORDER, -1, -1):
            if n > p + 1:
                continue
            g = s[p + 1 - n : p + 1]
            got = model.value(key(g, 0))
            if got == got:
                total += got
                break
            if n:
                back = model.value(key(g[:-1], 1))
                total += back if back == back else 0.0
        else:
            return float("nan")
    return total


@pytest.mark.parametrize("window", [3, 7, 64, 1 << 19])
def test_scores_equal_a_loop_over_characters(monkeypatch, window):
    texts = ["the cat sat on the mat the cat", "", "a", "é\U0001f600 x é\U0001f600 x", "the cat sat on the mat the cat", "ab" * 60]
    langs = ["en", "en", "en", "fr", "xx", "fr"]
    base = {int(kn.gram_keys([x], [""], 0)[0]): v for x, v in (("en", -3.0), ("fr", -4.0))}
    model = Known(base, "xx")
    monkeypatch.setattr(kn, "WINDOW", window)
    seeds = np.array([kn.lang_seed(x) for x in langs], np.uint64)
    sums, counts = kn.text_scores(texts, seeds, model)
    want = [plain_score(t, x, model) for t, x in zip(texts, langs, strict=True)]
    assert counts.tolist() == [len(t) + 1 if t else 0 for t in texts]
    np.testing.assert_allclose(sums, want, rtol=1e-4)
    assert np.isnan(sums[4]) and sums[1] == 0


def test_shards_give_each_key_its_value(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    files = []
    for k, keys in enumerate(([-9, -4, 0], [0, 3, 8])):
        pq.write_table(pa.table({"key": pa.array(keys, pa.int64()), "value": pa.array([x / 2 for x in keys], pa.float32())}), tmp_path / f"{k}.parquet")
        files.append((f"{tmp_path}/{k}.parquet", keys[0], keys[-1], len(keys)))
    for resident in (2, 100):
        got = kn.Shards(tuple(files), resident).values(np.array([8, -4, 1, 8, -9, 0, 99, -99], np.int64))
        np.testing.assert_array_equal(got, np.array([4, -2, np.nan, 4, -4.5, 0, np.nan, np.nan], np.float32))
        assert len(kn.Shards(tuple(files)).values(np.zeros(0, np.int64))) == 0
