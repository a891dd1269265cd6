"""What a worker keeps of the words it has seen when a task is over."""

import pyarrow as pa

from launchlake.llm import packing, tokens


def test_a_worker_keeps_no_large_table_of_words(spark):
    text = " ".join(f"w{i:x}q" for i in range(60_000))
    pieces = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1))
    got = [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces.orderBy("piece").collect()]

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"words": [sum(len(e._known) + len(e._older) for e in tokens._readers.values())]})

    assert max(r.words for r in spark.range(0, 8, 1, 8).mapInArrow(held, "words long").collect()) <= 50_000
    # the words are learned again and give the same ids
    assert got == [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces.orderBy("piece").collect()]
    assert got[-1][1] + got[-1][2] == len(tokens.encoder().encode([text])[0]) // 4 + 1
