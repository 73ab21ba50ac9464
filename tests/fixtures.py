"""Profiles with known results."""

import json


def frame(name, url="", script="1", line=0):
    return {"functionName": name, "scriptId": script, "url": url, "lineNumber": line, "columnNumber": 0}


def node(i, name, children=(), hits=0, **f):
    return {"id": i, "callFrame": frame(name, **f), "hitCount": hits, "children": list(children)}


def profile(nodes, samples, deltas, labels=None, label_at=None, **more):
    p = {"nodes": nodes, "samples": samples, "timeDeltas": deltas, "startTime": 0, "endTime": sum(deltas)} | more
    if labels is not None:
        p["_async"] = {"version": 1, "labels": labels, "samples": label_at}
    return json.dumps(p)


CHAIN = [node(1, "(root)", [2], script=""), node(2, "load", [3], line=3), node(3, "parse", [4], line=29), node(4, "emit", line=41)]
RECURSION = [node(1, "(root)", [2], script=""), node(2, "descend", [3], line=6), node(3, "descend", [4], line=6), node(4, "bottom", line=17)]
HANDLER = [node(1, "(root)", [2], script=""), node(2, "serve", [3], url="/srv/app/web.js", line=11), node(3, "fill", url="/srv/app/web.js", line=52)]
BLOCKED = [node(1, "(root)", [2, 3, 4], script=""), node(2, "crunch", script="s1", line=20, url="/srv/src/jobs/crunch.js"), node(3, "pack", script="s2", line=2, url="/srv/src/jobs/pack.js"), node(4, "(idle)", script="")]


def chain(samples=(3, 3, 4)):
    return profile(CHAIN, list(samples), [7] * len(samples))


def recursion(labels=None):
    return profile(RECURSION, [2, 3, 4], [4, 2, 9], labels, [0, 0, 0] if labels else None)


def handler():
    return profile(HANDLER, [3, 3, 2, 3], [5, 1, 3, 2], ["A", "B"], [0, 1, 0, 1])


def blocked():
    deltas = [700, 91_000, 700] + [1250] * 56 + [700]
    return profile(BLOCKED, [4, 2, 4] + [3] * 56 + [4], deltas, ["GET /a", "GET /b"], [-1, 0, -1] + [1] * 56 + [-1])
