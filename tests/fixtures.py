"""The small published cases and traces, and what they must give."""

import copy

CASES = {
    "aligned": ("c", "de", 8),
    "merge-cross-boundary": ("a", "b", 8),
    "nfc-cross-boundary": ("e", "́x", 8),
    "normalized-away": ("c", " ", 8),
    "partial-truncation": ("cde", "fghi", 6),
    "right-strip-drift": ("c ", "d", 8),
    "target-eliminated": ("cdef", "g", 5),
}
# case: full ids, cutoff, oracle, leakage, cross, target counts, classifications
CASE_RESULTS = {
    "aligned": ([1, 5, 6, 7], 2, 2, [], [], (2, 2, 2, 0), ["aligned"]),
    "merge-cross-boundary": ([1, 14], 2, None, [], [1], (0, 0, 0, 0), ["cross_boundary_token"]),
    "nfc-cross-boundary": ([1, 13, 12], 2, 2, [], [1], (1, 1, 1, 0), ["cross_boundary_token"]),
    "normalized-away": ([1, 5], 2, None, [], [], (0, 0, 0, 0), ["indeterminate"]),
    "partial-truncation": ([1, 5, 6, 7, 8, 9, 10, 11], 4, 4, [], [], (4, 2, 2, 2), ["partial_target_truncation"]),
    "right-strip-drift": ([1, 5, 2, 6], 2, 3, [2], [], (1, 1, 1, 0), ["boundary_drift"]),
    "target-eliminated": ([1, 5, 6, 7, 8, 9], 5, None, [], [], (1, 0, 0, 1), ["target_eliminated"]),
}
# Class letter and retained/full target tokens at max_length 2..9.
SWEEP = {
    "aligned": "E 0/2,P 1/2,A 2/2,A 2/2,A 2/2,A 2/2,A 2/2,A 2/2",
    "merge-cross-boundary": "X 0/0,X 0/0,X 0/0,X 0/0,X 0/0,X 0/0,X 0/0,X 0/0",
    "nfc-cross-boundary": "X 0/1,X 1/1,X 1/1,X 1/1,X 1/1,X 1/1,X 1/1,X 1/1",
    "normalized-away": "? 0/0,? 0/0,? 0/0,? 0/0,? 0/0,? 0/0,? 0/0,? 0/0",
    "partial-truncation": "E 0/4,E 0/4,E 0/4,P 1/4,P 2/4,P 3/4,A 4/4,A 4/4",
    "right-strip-drift": "E 0/1,E 0/1,D 1/1,D 1/1,D 1/1,D 1/1,D 1/1,D 1/1",
    "target-eliminated": "E 0/1,E 0/1,E 0/1,E 0/1,A 1/1,A 1/1,A 1/1,A 1/1",
}
MATRIX_TEXTS = ["a", "b", "ab", "c ", "e", "é", "é", " ", "z", "ᄀ", "ᅡ"]
MATRIX_COUNTS = {
    "aligned": 123, "boundary_drift": 35, "cross_boundary_token": 4, "indeterminate": 239,
    "indeterminate|boundary_drift": 21, "target_eliminated": 48, "target_eliminated|boundary_drift": 14,
}


def segments(spans):
    """Segment dicts from ``(prefix, [(start, content, end)...], suffix, padding)`` end positions."""
    prefix, messages, suffix, padding = spans
    out = [("prefix_special", None, 0, prefix)]
    at = prefix
    for index, ends in enumerate(messages):
        for kind, end in zip(("message_start", "message_content", "message_end"), ends):
            out.append((kind, index, at, end))
            at = end
    out += [("suffix_special", None, at, suffix), ("padding", None, suffix, padding)]
    return [dict(zip(("kind", "message_index", "start", "end"), s)) for s in out]


def document(example_id, messages, token_ids, spans):
    return copy.deepcopy({
        "schema_version": 1,
        "kind": "loss-topology.synthetic-pretokenized-trace",
        "example_id": example_id,
        "conversation": {"messages": [{"role": r, "content": c} for r, c in messages]},
        "trace": {"token_ids": token_ids, "padding_token_id": 0, "segments": segments(spans)},
    })


def healthy():
    """33 tokens, two assistant replies, two pads."""
    ids = [1, 10, 11, 101, 102, 12, 20, 21, 201, 202, 203, 22, 30, 31, 301, 302, 303, 304, 32, 20, 21, 204, 205, 22,
           30, 31, 305, 306, 307, 32, 2, 0, 0]
    messages = [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "v"), ("assistant", "b")]
    spans = (1, [(3, 5, 6), (8, 11, 12), (14, 18, 19), (21, 23, 24), (26, 29, 30)], 31, 33)
    return document("healthy-multiturn", messages, ids, spans)


def empty_assistant():
    """12 tokens; the only reply has no token."""
    ids = [1, 10, 101, 11, 20, 201, 202, 21, 30, 31, 2, 0]
    messages = [("system", "s"), ("user", "u"), ("assistant", "")]
    return document("empty-assistant-target", messages, ids, (1, [(2, 3, 4), (5, 7, 8), (9, 9, 10)], 11, 12))


def typed(doc):
    t = doc["trace"]
    return (
        doc["example_id"],
        [(m["role"], m["content"]) for m in doc["conversation"]["messages"]],
        (t["token_ids"], t["padding_token_id"],
         [(s["kind"], s["message_index"], s["start"], s["end"]) for s in t["segments"]]),
    )
