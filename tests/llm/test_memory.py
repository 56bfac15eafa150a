"""What Python workers and tables of long rows hold at once."""

import glob

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

from tessera.llm import languages, pieces, substrings, token_files, words
from tessera.llm.common import shared_dir


def test_other_operators_empty_caches():
    m, e = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model")), token_files.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    data = np.frombuffer(b"a text of words", np.uint8)
    for use in (lambda: words.split(data, np.array([0, len(data)]), "space"), lambda: languages.grams(data, np.array([0, len(data)]))):
        first = list(pieces._joined(m, ["a text of words"])), e.encode(["a text of words"], 0)
        assert len(m.cache) and len(e.cache)
        use()
        assert not (len(m.cache) or len(e.cache) or m.cache.old or e.cache.old)
        assert first == (list(pieces._joined(m, ["a text of words"])), e.encode(["a text of words"], 0))


def test_pieces_cache_holds_ids_once():
    m = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["plain words\nand lines", "  two  spaces ▁ mark", "\x01 x", "", "\n\nemoji \U0001f600 \u0000"]
    found = list(pieces._joined(m, texts))
    assert found == [(",".join(map(str, m.lib.encode(t))), m.lib.decode(m.lib.encode(t))) for t in texts]
    assert all(isinstance(v, str) for v in m.cache.values())
    m.cache["words\nand"] = m.cache["words"] = ("7", " other")  # a chunk with a text of its own
    (ids, text) = next(pieces._joined(m, ["plain words"]))
    assert ids.endswith(",7") and text == "plain other"


def test_units_stand_in_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(substrings, "UNIT_BYTES", 1 << 19)
    rng = np.random.default_rng(5)
    rows = [(i, bytes(rng.integers(0x61, 0x7B, 1 << 19, np.uint8)).decode()) for i in range(30)]
    path = shared_dir(spark, "units")
    log = substrings.SubstringLog(spark, path, 13)
    log._units(spark.createDataFrame(rows, "doc_id long, text string"), 1).count()
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path.removeprefix('file:')}/units-*/part*.parquet")]
    sizes = [f.row_group(g).total_byte_size for f in files for g in range(f.num_row_groups)]
    assert sum(f.num_rows for f in files) >= 15 and max(sizes) < 8 << 20
