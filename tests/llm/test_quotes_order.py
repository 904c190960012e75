"""Reply order of branching conversations, and quotations of other line breaks."""

from voxelgrid.llm import quotes


def order_of(parents):
    """Reply order by recursion: what continues a message first, then its other replies by turn."""
    replies = {}
    for t, p in parents.items():
        replies.setdefault(p, []).append(t)
    out = []

    def visit(t):
        out.append(t)
        for r in sorted(replies.get(t, []), key=lambda r: (r != t + 1, r)):
            visit(r)

    for t in sorted(replies.get(None, [])):
        visit(t)
    return out


def test_order_of_branches(spark):
    answers = [{6: 1, 7: 4}, {9: 2, 10: 1, 11: 8, 12: 3, 14: 9, 15: 0, 17: 10, 18: 10}, {k: k // 3 for k in range(2, 120, 2)}]
    rows, parents = [], {}
    for c, given in enumerate(answers):
        parents[c] = {t: given.get(t, t - 1 if t else None) for t in range(max(given) + 1)}
        rows += [(c, t, (f"> What was said in turn {p} of many\n" if t in given else "") + f"What was said in turn {t} of many") for t, p in parents[c].items()]
    got = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    for c, p in parents.items():
        mine = [r for r in got if r.conv_id == c]
        assert {r.turn: r.parent_turn for r in mine} == p
        want = order_of(p)
        assert [r.turn for r in sorted(mine, key=lambda r: r.position)] == want
        assert [r.turn for r in sorted(mine, key=lambda r: (r.path, r.turn))] == want
        assert sorted(r.position for r in mine) == list(range(len(p)))


def test_short_wrapped_and_partial_quotes(spark):
    long = "The first thing to say is short. The second one is rather longer and was wrapped. Is there a third?"
    said = ["Why?", "Yes.", long, "A plain remark without an end that\ngoes over two lines", "Something else."]
    replies = {
        5: ("> Why?\nBecause.", 0),
        6: ("> Yes.\nGood.", 1),
        7: ("> The first thing to say is short. The second one\n> is rather longer and was wrapped. Is there\n> a third?\nNo.", 2),
        8: ("> The second one is rather\n> longer and was wrapped.\nIt was.", 2),
        9: ("> A plain remark without an\n> end that goes over two lines\nIndeed.", 3),
        10: ("> ...\nNothing quoted.", 9),
    }
    rows = [(1, t, x) for t, x in enumerate(said)] + [(1, t, x) for t, (x, _) in replies.items()]
    rows += [(2, 0, "No."), (2, 1, "Maybe."), (2, 2, "> Yes.\nNot said here.")]
    got = {(r.conv_id, r.turn): r.parent_turn for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert {t: got[1, t] for t in replies} == {t: p for t, (_, p) in replies.items()}
    assert got[2, 2] == 1
