"""Plain-Python statements of the operator rules, written for small inputs."""

from __future__ import annotations


def split_long(text, limit, overlap):
    text = text.strip()
    if not text:
        return []
    parts, at = [], 0
    while True:
        if at + limit >= len(text):
            parts.append(text[at:].strip())
            break
        low = at + int(limit * 0.6)
        cut = max((i for i in range(low, at + limit) if text[i] in "\n。；，.;, "), default=at + limit)
        parts.append(text[at:cut].strip())
        at = max(at + 1, cut - overlap)
    return [p for p in parts if p]


def windows(sizes, hard, limit, overlap):
    """Spans (start, end) of the flat-document windows."""
    spans, held = [], []
    for i, size in enumerate(sizes):
        if hard[i]:
            if held:
                spans.append((held[0], held[-1] + 1))
            spans.append((i, i + 1))
            held = []
            continue
        if held and sum(sizes[k] for k in held) + size > limit:
            spans.append((held[0], held[-1] + 1))
            while held and sum(sizes[k] for k in held[1:]) > overlap:
                held = held[1:]
        held.append(i)
    if held:
        spans.append((held[0], held[-1] + 1))
    return spans


def micro_groups(items, micro, limit):
    """items: (type, path, page, text) -> list of index lists."""
    groups = []
    open_group = False
    for i, (kind, path, page, text) in enumerate(items):
        tiny = kind in ("term", "text") and len(text.strip()) < micro
        if tiny and open_group:
            last = groups[-1]
            _, p, g, _ = items[last[-1]]
            if p == path and g == page and sum(len(items[k][3]) for k in last) + len(text) <= limit:
                last.append(i)
                continue
        groups.append([i])
        open_group = tiny
    return groups


def category_links(order, prior):
    """Greedy links of one group; ``prior`` holds frozensets of already adjacent pairs."""
    near = {frozenset(p) for p in prior}
    made = set()
    for i in order:
        left = 5
        for j in order:
            pair = frozenset((i, j))
            if left == 0:
                break
            if i == j or pair in near:
                continue
            near.add(pair)
            made.add(pair)
            left -= 1
    return made


def bfs(edges, starts, depth, cap):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, front, walked = set(starts), set(starts), []
    for _ in range(depth):
        if len(seen) >= cap:
            break
        nxt = {(n, m) for n in front for m in near.get(n, ()) if m not in seen}
        walked += sorted(nxt)
        front = {m for _, m in nxt}
        seen |= front
        if not front:
            break
    return seen, walked


def suggest(chunks, suggestions):
    """chunks: (id, text); suggestions: id -> (action, text, target)."""
    out, skip = [], set()
    texts = dict(chunks)
    for cid, text in chunks:
        if cid in skip:
            continue
        action, new, target = suggestions.get(cid, ("keep", "", ""))
        if action == "delete":
            continue
        if action == "update" and new.strip():
            text = new.strip()
        if action == "merge_with_next" and target:
            skip.add(target)
            if target in texts:
                text = text.strip() + "\n\n" + texts[target].strip()
        out.append((cid, text))
    return out


def condense(turns, marks):
    """Standalone queries of one conversation, in order."""
    out = []
    for i, q in enumerate(q.strip() for q in turns):
        anchor = (out[-1] or turns[i - 1]) if out else ""
        out.append(f'基于"{anchor}"：{q}' if q and anchor.strip() and any(m in q for m in marks) else q)
    return out


def node_score(terms, label, heading, category):
    joined = f"{label} {heading} {category}"
    total = sum(3.0 if t in heading else 2.5 if t in label else 1.5 for t in terms if t in joined)
    if total:
        return total
    grams = [t[i:i + 2] for t in terms if len(t) > 1 for i in range(len(t) - 1)]
    return sum(g in joined for g in grams) / max(len(grams), 1) * 1.5
