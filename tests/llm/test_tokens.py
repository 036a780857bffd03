"""Token counts against the library on whole texts."""

import sentencepiece
from helpers import ODD, docs_frame, prose

from strikeline.llm import tokens
from strikeline.llm.queries import vocabulary

FILE = "piece_bpe_32k.model"


def test_counts_equal_those_of_whole_texts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(FILE))
    texts = [*ODD, "<s> </s> <unk> x", "a ", "  ", " ", "tail   ", "\n\n", "▁▁a ▁ b", " ".join(prose(500, 5)), "🙂 👍🏽 é"]
    for head in (0, 5, 1000):
        got = tokens.count_tokens(docs_frame(spark, texts, clashes=True), vocabulary(FILE), head=head).orderBy("doc_id").collect()
        assert [r.n_tokens for r in got] == [len(sp.encode(t or "")) for t in texts]
        assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = docs_frame(spark, ["one two", "one two", "one two"], [None, 7, 7])
    got = tokens.count_tokens(df, vocabulary(FILE)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "7", "None"] and len({r.n_tokens for r in got}) == 1
    assert tokens.count_tokens(df.limit(0), vocabulary(FILE)).count() == 0


def test_tasks_send_counts_on_when_they_hold_many(spark, monkeypatch):
    df = docs_frame(spark, [" ".join(prose(300, 8))])
    assert {r.unit: r.n for r in tokens.distinct_pretokens(df, "text").collect()} == {w: prose(300, 8).count(w) for w in prose(300, 8)}
