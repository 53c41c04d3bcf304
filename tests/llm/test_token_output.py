import zlib

import numpy as np
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from clickrank.llm import token_output as o
from clickrank.llm import tokens

ROWS = [(9, "some text here\nand more"), (3, None), (4, ""), (None, "null id"), (7, "twice"), (7, "twice"), (7, "other"), (1, "long " * 20_000), (2, "ünï 中   x")]


def test_round_trip(spark, table, tmp_path):
    path = f"{tmp_path}/tokens"
    o.write_tokens(table(ROWS), f"file://{path}")
    tokenizer = Tokenizer.from_file(tokens.public_file(o.VOCABULARY))
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in ROWS}
    rows = o.token_index(spark, f"file://{path}").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 7, 7, 7, 9]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    crc = lambda t: zlib.crc32(np.array(ids[t], "<u4").tobytes())
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i or 0, len(ids[t]), crc(t)) for i, t in ROWS)
    some = o.read_tokens(spark, f"file://{path}", 2, 4).collect()
    assert sorted((r.doc_id, r.tokens) for r in some) == [(2, ids[ROWS[8][1]]), (3, [2]), (4, [2])]


def test_file_layout(table, tmp_path):
    path = f"{tmp_path}/tokens"
    o.write_tokens(table([(i, f"text number {i} " * 50) for i in range(3000)]), f"file://{path}", row_group_bytes=30_000, page_bytes=4096)
    files = sorted(f for f in ds.dataset(path).files)
    first = pq.ParquetFile(files[0])
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > len(files)
    columns = {first.metadata.row_group(0).column(i).path_in_schema: first.metadata.row_group(0).column(i) for i in range(first.metadata.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    ids = [pq.read_table(f, columns=["doc_id"]).column("doc_id").to_pylist() for f in files]
    assert [i for part in ids for i in part] == list(range(3000))


def test_empty(spark, table, tmp_path):
    o.write_tokens(table([]), f"file://{tmp_path}/none")
    assert o.token_index(spark, f"file://{tmp_path}/none").count() == 0
