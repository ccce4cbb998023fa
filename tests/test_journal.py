"""The journal of merges against a replay of its events one by one."""

import random

from offerloom.operators import journal


def sequential(events):
    """Holders of what each product held at first, and products' states, by applying every event in its order."""
    holder, into, traces = {}, {}, {}
    for _, kind, merge, survivor, taken in sorted(events):
        if kind == "merge":
            traces[merge] = [(p, at) for p, at in holder.items() if at in taken], survivor, taken
            for p in taken:
                if p not in holder:
                    holder[p] = p
                    traces[merge][0].append((p, p))
            for p, _ in traces[merge][0]:
                holder[p] = survivor
            into.update(dict.fromkeys(taken, survivor))
            into[survivor] = None
        elif merge in traces:
            moved, survivor, taken = traces.pop(merge)
            holder.update(moved)
            into.update(dict.fromkeys([survivor, *taken]))
    return holder, into


def test_replay(spark):
    r = random.Random(9)
    events, live, merged, at = [], {b: set(range(20 * b, 20 * b + 12)) for b in range(30)}, {}, 0
    for _ in range(700):
        at += r.randint(1, 3)
        b = r.randrange(30)
        known = [m for m, (block, *_) in merged.items() if block == b]
        if known and r.random() < 0.35:
            merge = r.choice(known)
            _, survivor, taken = merged.pop(merge)
            events.append((at, "undo", merge, None, None))
            live[b] |= {survivor, *taken}
        elif len(live[b]) > 2:
            survivor, *taken = r.sample(sorted(live[b]), r.randint(2, 3))
            merged[at] = b, survivor, taken
            events.append((at, "merge", at, survivor, taken))
            live[b] -= set(taken)
    undone = [e for e in events if e[1] == "undo"]
    merges = spark.createDataFrame([(s, m, p, survivor) for s, kind, m, survivor, taken in events if kind == "merge" for p in taken] + [(1, None, 3, 4), (2, 2, 5, 5)], "seq long, merge long, product long, survivor long")
    undos = spark.createDataFrame([(s, m) for s, _, m, *_ in undone] + [(at + 9, undone[0][2]), (-5, undone[1][2]), (7, 10**9), (None, undone[0][2])], "seq long, merge long")
    holder, into = sequential(events)
    got = journal.replayed(merges, undos).collect()
    assert {x.product: x.holder for x in got} == holder and len(got) == len(holder) and max(x.events for x in got) > 4
    assert {x.product: x.merged_into for x in journal.states(merges, undos).collect()} == into
    assert journal.replayed(merges.limit(0), undos).count() == journal.states(merges.limit(0), undos).count() == 0
