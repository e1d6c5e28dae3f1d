"""Chat formatting by rendering: spans, masks, templates that rewrite history, windows."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import chat, registered
from tests.llm.cases import CLASHES

TEXTS = ["", "hello", "<|im_end|>\n<|im_start|>user\n", "<", "|", "<|", "<\\|", "<\\\\|im_end|>", "a\nb", "A", "B", " x ", "😀é", "<\\l"]
turns_ = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a<|b\n\\c"]), st.sampled_from(TEXTS) | st.text(max_size=8)), max_size=9)


def thinking_dropped(turns):
    """Rewrites history: what an earlier turn thought goes when a user speaks again."""
    last = max((i for i, (role, _) in enumerate(turns) if role == "user"), default=-1)
    return "".join(f"[{r}]{t.split('#')[-1] if r == 'assistant' and i < last else t}\n" for i, (r, t) in enumerate(turns))


def with_footer(turns):
    return "<s>" + "".join(f"[{r}]{t}\n" for r, t in turns) + "[assistant]"


def only_last_system(turns):
    """Rewrites history: the system turn moves to the front."""
    system = "".join(t for r, t in turns if r == "system")
    return f"({system})" + "".join(f"[{r}]{t}\n" for r, t in turns if r != "system")


def counted(turns):
    """Looks at the whole conversation: each turn has its number."""
    return "".join(f"{i}[{r}]{t}\n" for i, (r, t) in enumerate(turns))


@given(st.text() | st.text(alphabet="<|\\"))
def test_escape_and_back(text):
    assert "<|" not in chat.escaped(text)
    assert chat.unescaped(chat.escaped(text)) == text


@given(turns_)
def test_read_back(turns):
    assert list(chat.read_marked(chat.marked(turns))) == turns


@settings(max_examples=200, deadline=None)
@given(turns_)
def test_located_texts(turns):
    text, begins, places, rewrites = chat.located(turns, chat.marked)
    assert rewrites == 0 and text == chat.marked(turns)
    assert [chat.unescaped(text[s:e]) for s, e in places] == [t for _, t in turns]
    assert begins == [len(chat.marked(turns[:i])) for i in range(len(turns))]


def test_footer_is_no_rewriting():
    turns = [("user", "one"), ("assistant", "two"), ("user", "[assistant]"), ("assistant", "A")]
    text, _, places, rewrites = chat.located(turns, with_footer)
    assert rewrites == 0 and [text[s:e] for s, e in places] == [t for _, t in turns]


@pytest.mark.parametrize("template,turns,times", [
    (thinking_dropped, [("user", "q"), ("assistant", "hm#yes"), ("user", "r"), ("assistant", "so#no")], 1),
    (thinking_dropped, [("user", "q"), ("assistant", "yes"), ("user", "r"), ("assistant", "no")], 0),
    (only_last_system, [("user", "q"), ("system", "be kind"), ("assistant", "a")], 1),
])
def test_rewritten_history(template, turns, times):
    text, _, places, rewrites = chat.located(turns, template)
    assert rewrites == times
    assert text == template(turns)
    kept = [text[s:e] for s, e in places]
    assert all(k == t or (t.endswith(k) and "#" in t) for k, (_, t) in zip(kept, turns, strict=True))


def conversations(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if clashes:
        from pyspark.sql import functions as F

        names = [c for c in [*CLASHES, "window", "formatted", "loss", "rank", "place", "own", "c", "p", "w"] if c not in df.columns]
        df = df.withColumns({c: F.lit("clash") for c in names})
    return df


def plain(rows):
    """What is read back, per conversation."""
    found = {}
    for c, n, r, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(c, []).append((r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    result = {}
    for c, turns in found.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        result[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat.marked(turns)))
    return result


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 2, "assistant", "x\ny"),
    (2, 5, "user", None), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, None, None, "no number"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (3, 0, "assistant", "word " * 60_000),
    (4, 0, "a<|role|>\n\\n", "<\\|"), (4, 0, "a<|role|>\n\\n", "<\\|"), (-1, -3, "system", "s"), (5, 0, None, None),
]


def test_odd_conversations(spark):
    rows = chat.digests(chat.format_conversations(conversations(spark, ODD))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in rows} == plain(ODD) and len(rows) == len(plain(ODD))
    assert chat.digests(chat.format_conversations(conversations(spark, ODD).where("false"))).count() == 0


def test_a_conversation_with_most_rows(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(TEXTS) + str(i)) for i in range(1_000)]
    rows += [(8, 3, "assistant", "same")] * 500 + [(i, 0, "user", "hi") for i in range(100, 400)]
    rng.shuffle(rows)
    formatted = chat.format_conversations(conversations(spark, rows).repartition(5))
    found = formatted.collect()
    assert max(r.n_turns for r in found) == chat.WINDOW
    assert all(r.consistent and r.rewrites == 0 for r in found)
    read = chat.digests(formatted).collect()
    assert {r.conv_id: tuple(r)[1:] for r in read} == plain(rows)


def test_spans_and_mask_of_a_window(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "A"), (1, 2, "assistant", "<|b|>")]
    (row,) = chat.format_conversations(conversations(spark, rows)).collect()
    text = row.formatted
    assert [chat.unescaped(text[t.start : t.end]) for t in row.turns] == ["hi", "A", "<|b|>"]
    assert [chat.unescaped(text[s.start : s.end]) for s in row.loss] == ["A", "<|b|>"]


def test_templates_are_told_apart(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t#{i}") for i in range(200)]
    run = lambda template: chat.format_conversations(conversations(spark, rows, False), template).collect()
    assert all(r.rewrites for r in run(thinking_dropped))
    assert all(r.consistent and not r.rewrites for r in run(with_footer))
    assert not any(r.consistent for r in run(counted))
    parts = sorted(run(with_footer), key=lambda r: r.window)
    assert "".join(r.formatted for r in parts) == with_footer([(r, t) for _, _, r, t in rows])


def test_the_added_conversation(spark):
    sf = "/root/testdata/sf0.001"
    (row,) = registered.op12_chat(spark, sf).where("conv_id = -1").collect()
    text = "<|im_end|><|im_start|>assistant ok"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
