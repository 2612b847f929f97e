from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vetgrid.llm import chat
from vetgrid.llm.chat import Costs, digests, escape, formatted, read_turns, text_parts, unescape

CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, parts string, tie int"
PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def plain(spark, rows):
    return text_parts(spark.createDataFrame([(*r, 1, "p", 2) for r in rows], CONVERSATIONS))


def part(kind, text=None, ref=None, **size):
    return (kind, text, ref, size.get("width"), size.get("height"), size.get("seconds"), size.get("pages"))


def brute(rows):
    """Digests from a single pass over sorted rows."""
    from hashlib import sha256
    result = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        result[conv] = (len(own), sha256(turns.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest())
    return result


@given(st.lists(st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "/", "INST]", "s>", "é", "\n", "x"]), max_size=8))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_control(pieces):
    text = "".join(pieces)
    written = escape(text)
    assert unescape(written) == text
    assert not any(c in written for c in chat.CONTROLS)


@given(st.text(), st.text(), st.text(alphabet="[]<>/\\INST_s"))
@settings(max_examples=200, deadline=None)
def test_turns_read_back(role, text, other):
    writer = chat.Flattener(Costs())
    said = [(role, text), ("user", other), ("assistant", text + "<"), ("assistant", "/s>" + other)]
    for who, what in said:
        writer.turn(who, [{"kind": "text", "text": what}])
    read = [(who, "".join(t for _, t in parts)) for who, parts in read_turns("".join(writer.pieces))]
    assert read == said


def test_against_brute_force_over_many_partitions(spark):
    draw = random.Random(3)
    rows = [(7, t, draw.choice(["user", "assistant"]), "long conversation %d </s> " % t * draw.randrange(4)) for t in range(900)]
    rows += [(c, t, draw.choice(["system", "user", "assistant", "tool [BODY]", None]), draw.choice([None, "", "x", "[INST] <\\/s>"]))
             for c in [None, *range(20, 60)] for t in range(draw.randrange(1, 6))]
    rows += [(90, None, "user", "first"), (90, 3, "assistant", "é\U0001f600"), (91, 0, "assistant", "y" * 300_000)]
    frame = plain(spark, rows).repartition(5)
    for limit in (200, 1 << 20):
        found = digests(formatted(frame, segment_chars=limit)).collect()
        assert len(found) == len({r[0] for r in rows})
        assert {r["conv_id"]: tuple(r)[1:5] for r in found} == brute(rows)


def test_segments_are_bounded_and_cut_between_turns(spark):
    rows = [(1, t, "user", "w" * 100) for t in range(50)]
    segments = formatted(plain(spark, rows).coalesce(1), segment_chars=500).orderBy("part").collect()
    assert len(segments) > 5 and sum(s["n_turns"] for s in segments) == 50
    assert all(len(s["text"]) < 500 + 116 for s in segments)


def test_typed_parts(spark):
    rows = [(1, 0, "user", [part("text", "see <"), part("text", "/s> "), part("image", ref="a.png", width=28, height=15),
                            part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=3), part("text", "?")]),
            (1, 1, "assistant", [part("text", "a"), None, part("image", ref=None), part("text", "b[IMG]")]),
            (2, 0, "user", None), (2, 1, "user", [])]
    segments = {s["conv_id"]: s for s in formatted(spark.createDataFrame(rows, PARTS)).collect()}
    one = segments[1]
    costs = Costs()
    assert [(a["kind"], a["number"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        ("image", 0, "a.png", 2 * 3), ("audio", 1, "b.wav", 25), ("document", 2, "c.pdf", 3 * costs.page),
        ("image", 3, None, 2)]
    for a in one["attachments"]:
        assert one["text"].startswith(chat.PLACEHOLDERS[a["kind"]], a["at"])
    turns = list(read_turns(one["text"]))
    assert turns[0] == ("user", [("text", "see </s> "), ("image", ""), ("audio", ""), ("document", ""), ("text", "?")])
    assert turns[1] == ("assistant", [("text", "a"), ("image", ""), ("text", "b[IMG]")])
    learned = [unescape(one["text"][s["start"]:s["start"] + s["length"]]) for s in one["loss"]]
    assert learned == ["a", "b[IMG]"]
    assert list(read_turns(segments[2]["text"])) == [("user", []), ("user", [])]


def test_costs():
    assert Costs().image(1540, 1540) == 110 * 111
    assert Costs().image(15400, 1) == 111 and Costs().image(None, 0) == 2
    assert Costs().audio(None) == 1 and Costs().audio(0.1) == 2 and Costs().document(0) == 256


def test_unknown_kind_ends_the_job(spark):
    with pytest.raises(Exception, match="unknown kind of content part: video"):
        formatted(spark.createDataFrame([(1, 0, "user", [part("video")])], PARTS)).collect()


def test_repeated_rows_and_empty_table(spark):
    twice = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")]
    assert digests(formatted(plain(spark, twice))).first()["n_turns"] == 3
    assert digests(formatted(plain(spark, []))).count() == 0
