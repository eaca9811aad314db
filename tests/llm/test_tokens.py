"""Ids put together from cached pieces are those of the library on whole texts; files keep what they promise."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from causeway.llm import token_files
from causeway.llm.tokens import PieceEncoder, tokenizer_path


@pytest.mark.parametrize("name, blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole_texts(name, blanks):
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "\t", "Don't", "1,024", "é", "ß", "ñandú", "x" * 40, "<|endoftext|>", "a.b", "?!", "中文", "🙂", " ", "token=\"a\"", "A", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", " ", None]
    path = tokenizer_path(name)
    ids, sizes = PieceEncoder(path, blanks).encode(pa.array(texts, pa.string()))
    whole, at = Tokenizer.from_file(path), 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
        at += n
    assert at == len(ids)


def test_files_have_the_encodings(spark, tmp_path):
    rows = [(k, f"text number {k} of the file, with words. " * 20, "s", "en") for k in range(3000)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1), f"file://{tmp_path}/t")
    file = next(p for p in sorted((tmp_path / "t" / "tokens").glob("*.parquet")) if pq.read_metadata(p).num_rows)
    group = pq.read_metadata(file).row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    for name in ("doc_id", "before", "n_tokens"):
        assert "DELTA_BINARY_PACKED" in columns[name].encodings and columns[name].has_column_index and columns[name].has_offset_index
    ids = next(c for n, c in columns.items() if n.startswith("token_ids"))
    assert "RLE_DICTIONARY" in ids.encodings and ids.has_dictionary_page and ids.has_offset_index
