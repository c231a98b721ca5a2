"""Token alignment, chat formatting and the filter audit against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorday.llm import chat_format, filter_audit, token_align
from priorday.llm.bpe import byte_letters, default_path


def docs_of(spark, texts, n=2):
    return spark.createDataFrame([(i, t, i, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, block long, pair string, n int").repartition(n)


# --- token alignment -----------------------------------------------------------


def brute_alignment(texts):
    """Tokens by the two libraries, groups by walking both ends, counts by a dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_path())
    lib.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=token_align.default_pieces())
    letters = byte_letters()
    name_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    links, rows = [], []
    for text in texts:
        a = lib.encode(" " + (text or ""), add_special_tokens=False)
        b = pieces.encode(text or "")
        raw_a, raw_b = ([bytes(letters[c] for c in t) for t in a.tokens], [name_b(pieces.id_to_piece(i)) for i in b])
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            links.append(Counter()), rows.append((0, 0, 0, 0, ""))
            continue
        end_a, end_b = np.cumsum(list(map(len, raw_a))), np.cumsum(list(map(len, raw_b)))
        both = sorted(set(end_a.tolist()) & set(end_b.tolist()))
        found, i, j = [], 0, 0
        for end in both:
            x, y = int(np.searchsorted(end_a, end)) + 1, int(np.searchsorted(end_b, end)) + 1
            found.append((a.ids[i:x], b[j:y]))
            i, j = x, y
        mine = Counter((p, q) for g, h in found for p in g for q in h)
        spelled = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in found)
        links.append(mine), rows.append((len(a.ids), len(b), len(found), sum(mine.values()), hashlib.sha256(spelled.encode()).hexdigest()))
    held = Counter(p for mine in links for p in mine)
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    return [(*row[:4], sum(n for p, n in mine.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in mine.items()), row[4]) for mine, row in zip(links, rows, strict=True)]


def awkward_texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "Zürich", "naïve", "漢字", "😀", "don't", "x" * 9, "3.1415", "<s>", "</s>", "<|endoftext|>", "#!", "é", "ﬁ", " ", "á", "\x1c", "0f3a"]
    texts = [None, "", " ", "  ", "\n", "a▁b", "▁", " lead", "trail ", "trail\t", "two  spaces\n\nand lines\n ", "\ttab\t\n x", "<|endoftext|>", "a<|endoftext|>b <s>", "z" * 5000, "ab" * 3000 + " c", "\x00\x01", "x  y\u0085 z"]
    return texts + ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "\n", "  ", "", "\t ", " \n"]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_alignment_equals_brute_force(spark):
    texts = awkward_texts(5, 150)
    texts += texts[20:30] * 2
    got = {r.doc_id: tuple(r)[1:] for r in token_align.alignments(docs_of(spark, texts, 3)).collect()}
    for i, want in enumerate(brute_alignment(texts)):
        assert got[i] == want, texts[i]
    assert token_align.alignments(docs_of(spark, texts).where("doc_id < 0")).count() == 0


def test_alignment_of_awkward_rows(spark):
    rows = [(None, "same text"), (None, "same text"), (7, "same text"), (7, "other words"), (8, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_groups, r.count_sum) for r in token_align.alignments(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 5 and got[-1] == got[-2] and got[2][:2] == (False, 8) and got[2][2:] == (0, 0, 0)
    groups = token_align.groups("same text")
    assert got[-1][3] == len(groups) and got[-1][4] == 3 * sum(len(a) * len(b) for a, b in groups)


def test_alignment_of_a_long_text_and_small_worker_tables(spark, monkeypatch):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(1, 9))) for _ in range(200_000))
    ids_a, n_a, ids_b, n_b = token_align.both(default_path(), token_align.default_pieces()).encode([long])
    groups = token_align.groups(long)
    assert [i for a, _ in groups for i in a] == ids_a.tolist() and [i for _, b in groups for i in b] == ids_b.tolist() and n_a[0] == len(ids_a) and n_b[0] == len(ids_b)
    monkeypatch.setattr(token_align, "CHUNKS", 50)
    monkeypatch.setattr(token_align, "WIDE", 1)
    texts = awkward_texts(8, 60)
    want = brute_alignment(texts)
    made = token_align.aligned(texts, default_path(), token_align.default_pieces())
    again = token_align.aligned(texts, default_path(), token_align.default_pieces())
    for i, row in enumerate(want):
        assert (made["n_a"][i], made["n_b"][i], made["n_groups"][i], made["n_links"][i], made["groups_sha256"][i]) == (*row[:4], row[6])
    assert (made["keys"] == again["keys"]).all() and made["times"].sum() == made["n_links"].sum()


@pytest.mark.parametrize("seed", range(20))
def test_groups_meet_at_all_common_ends(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 5, 60, 400])
    share = rng.choice([0.02, 0.2, 0.9])
    texts = [sorted(rng.sample(range(1, n + 1), rng.randint(1, n)) + [n]) for _ in range(6)]
    others = [sorted({x for x in t if rng.random() < share} | set(rng.sample(range(1, n + 1), n // 4)) | {n}) for t in texts]
    texts = [sorted(set(t)) for t in texts]
    end_a = np.array([x + i * n for i, t in enumerate(texts) for x in t])
    end_b = np.array([x + i * n for i, t in enumerate(others) for x in t])
    got = token_align.shared_groups(end_a, end_b, np.cumsum([len(t) for t in texts]))
    assert got.tolist() == [k + 1 for k, x in enumerate(end_a.tolist()) if x in set(end_b.tolist())]


# --- filter audit ----------------------------------------------------------------


def brute_audit(rows, labels):
    """Every order applied to every document, one step after the other."""
    marks = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        if i is not None:
            marks[i] = [marks[i][0] or q == 1, marks[i][1] or t == 1]
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    judged = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        judged.append((source or "", {c for c in fails if fails[c]}, *(marks[i] if i is not None else [False, False])))
    out = {}
    for part in {x[0] for x in judged}:
        mine = [x for x in judged if x[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shapley[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(c in x[1] for x in mine) - len(gone), sum(x[1] == {c} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        n = rng.choice([0, 3, 150, 230, 260])
        kinds = rng.choice([20, 400])
        w = [f"w{rng.randint(0, kinds)}" for _ in range(n)] + rng.choice([[], [], ["AB"] * 9, ["a|b"], ["\x1cé"]])
        rows.append((i if rng.random() < 0.9 else None, " \n".join(w) if rng.random() < 0.95 else None, rng.choice(["s", "t", "", None])))
    rows += [(rng.choice([None, 3, 3, 500, 501]), rng.choice(rows)[1], rng.choice("st")) for _ in range(60)]
    rows += [(1, "one text", "s"), (1, "one text", "t"), (1, "one text", "t"), (2, "one text", "s"), (None, "one text", "t")]
    labels = [(rng.choice([None, *range(160)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(1, 0, 1), (1, 1, 0)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, digest string").repartition(3)
    marks = spark.createDataFrame([(*r, 2) for r in labels], "doc_id long, quality int, toxic int, spread int")
    got = filter_audit.audit(docs, marks).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert list(r)[3:] == want[r.part, r.filter_order, r.step], r
    assert filter_audit.audit(docs.where("doc_id < 0"), marks).count() == 0
    assert all(r.good_lost == 0 for r in filter_audit.audit(docs, marks.where("doc_id < 0")).collect())


def test_filter_audit_takes_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "p"), (2, "b", "p"), (3, "ab", "q")], "doc_id long, text string, kind string")
    rows = filter_audit.audit(docs, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"), {"x": F.col("text").contains("a"), "y": F.length("text") == 1}, part="kind").collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.good_lost, r.shapley) for r in rows} == {
        ("p", "xy", 1): (1, 1, 0, 2), ("p", "xy", 2): (0, 1, 1, 2), ("p", "yx", 1): (1, 1, 1, 2), ("p", "yx", 2): (0, 1, 0, 2),
        ("q", "xy", 1): (0, 1, 0, 2), ("q", "xy", 2): (0, 0, 0, 0), ("q", "yx", 1): (1, 0, 0, 0), ("q", "yx", 2): (0, 1, 0, 2),
    }
    with pytest.raises(ValueError):
        filter_audit.audit(docs, docs, {})


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_intervals_are_the_orders_in_which_a_mask_falls(k):
    spans = filter_audit.removal_intervals(k)
    letters = "ABCDEF"[:k]
    for rank, order in enumerate(filter_audit.orders(letters)):
        for mask in range(1, 1 << k):
            step = min(order.index(letters[i]) for i in range(k) if mask >> i & 1) + 1
            assert [s for m, s, lo, hi in spans if m == mask and lo <= rank < hi] == [step]


# --- chat formatting -------------------------------------------------------------

ODD = ["</s>", "<s>", "[INST]", "[/INST]", "<\\/s>", "[\\\\INST]", "<", "[", "\\", "/s>", "INST]", "\n", "a", "é", "😀", " ", "<|im_end|>", "<think>x</think>"]


def odd_text(rng, most=8):
    return "".join(rng.choice(ODD) for _ in range(rng.randint(0, most)))


def test_escapes_come_back_and_hide_control_strings():
    rng = random.Random(10)
    for _ in range(3000):
        t = odd_text(rng, 14)
        safe = chat_format.escaped(t, chat_format.CONTROLS)
        assert chat_format.unescaped(safe, chat_format.CONTROLS) == t and not any(c in safe for c in chat_format.CONTROLS)


def rendered(turns, template, **how):
    state = chat_format.Rendering(template, **how)
    return [r for turn in turns for r in state.add(*turn)] + state.finish()


def closing(turns):  # an end mark behind the last turn only
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) + "<|end|>"


def thoughtless(turns):  # thoughts of earlier turns are dropped
    return "".join(f"[{r}]" + (t if i == len(turns) - 1 else re.sub("<think>.*?</think>", "", t)) + "[end]" for i, (r, t) in enumerate(turns))


def system_last(turns):  # the system's text stands before the last user's
    users = [i for i, (r, _) in enumerate(turns) if r == "user"]
    system = "".join(t for r, t in turns if r == "system")
    return "".join(f"[{r}]{system + '|' if users and i == users[-1] else ''}{t}[end]" for i, (r, t) in enumerate(turns) if r != "system")


@pytest.mark.parametrize("render", [chat_format.instruct, closing, thoughtless, system_last])
@pytest.mark.parametrize("reach", [2, 6, None])
def test_pieces_join_to_the_last_output(render, reach):
    rng = random.Random(11)
    template = chat_format.Template(render, chat_format.CONTROLS if render is chat_format.instruct else ())
    for n in [1, 2, 3, 7, 16, 60]:
        turns = [("user" if i % 2 else "assistant", odd_text(rng)) for i in range(n)]
        if n > 2:
            turns[0] = ("system", "be kind")
        rows = rendered(turns, template, reach=reach)
        whole = render(turns)
        assert "".join(r.piece for r in rows) == whole and [r.number for r in rows] == list(range(1, n + 1))
        at = 0
        for r in rows:
            assert r.start == at and r.start <= r.text_start <= r.text_end <= r.end
            at = r.end
            if not r.stale and not r.altered:
                inside = whole[r.text_start : r.text_end]
                assert (chat_format.unescaped(inside, template.controls) if template.controls else inside) == r.text
        if render in (chat_format.instruct, closing):
            assert not any(r.rewrites or r.stale or r.altered for r in rows)


def test_rewritten_history_leaves_the_mask():
    turns = [("user", "hi"), ("assistant", "<think>so</think>yes"), ("user", "why"), ("assistant", "<think>hm</think>no")]
    rows = rendered(turns, chat_format.Template(thoughtless))
    assert [r.stale for r in rows] == [False, True, False, False] and [r.rewrites for r in rows] == [False, False, True, False]
    rows = rendered([("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")], chat_format.Template(system_last))
    assert rows[0].altered and [r.rewrites for r in rows] == [False, False, False, True] and [r.stale for r in rows] == [False, True, True, False]
    far = chat_format.Template(lambda turns: str(len(turns)) + "".join(t for _, t in turns))  # counts the turns at its start
    with pytest.raises(ValueError):
        rendered([("user", "a")] * 40, far)


def conversations(rng):
    rows = []
    for conv in [None, *range(30)]:
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "assistant", "system", "tool", None, "", "od\\d\nrole", "[INST]"]), odd_text(rng) if rng.random() < 0.9 else None))
    rows += [rows[5], rows[5], (40, 1, "assistant", ""), (41, 0, "user", "</s>" * 100_000), (41, 1, "assistant", "x [/INST]" * 100_000)]
    rng.shuffle(rows)
    return rows


def test_chats_are_read_back(spark):
    rows = conversations(random.Random(12))
    table = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, number int, piece string").repartition(3)
    pieces = chat_format.formatted(chat_format.with_probe(table))
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(pieces).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    whole = defaultdict(str)
    for r in pieces.collect():
        assert r.start == len(whole[r.conv_id]) and r.number
        whole[r.conv_id] += r.piece
    assert got.keys() == convs.keys()
    for conv, mine in convs.items():
        turns = [(role, text) for _, (_, role), (_, text) in sorted(mine)]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert whole[conv] == chat_format.instruct(turns)
        assert got[conv] == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole[conv]), 0, 0)
    assert chat_format.read_back(chat_format.formatted(table.where("conv_id < -5"))).count() == 0
