"""A sequential model of normalisation on plain Python trees, written apart from the DataFrame operators."""

from __future__ import annotations

import re
import unicodedata


def u64(s):
    if not isinstance(s, str) or not re.fullmatch(r"\+?[0-9]+", s, re.ASCII):
        return None
    n = int(s)
    return n if n < 1 << 64 else None


def trim(s):
    return s.strip()


def canonical(url):
    t = trim(url).split("#", 1)[0]
    if "://" not in t:
        return t
    scheme, rest = t.split("://", 1)
    cut = min((rest.index(c) for c in "/?" if c in rest), default=len(rest))
    return scheme.lower() + "://" + rest[:cut].lower() + rest[cut:]


class Node:
    def __init__(self, given, depth, path, parent):
        self.given, self.depth, self.path, self.parent = dict(given), depth, path, parent
        self.children, self.arena = [], None

    def get(self, k):
        return self.given.get(k)


def build(doc):
    """Nodes of a document in arena order: depth-1 nodes forward, each with its subtree; below, sibling blocks
    by a work list, each block last sibling first."""
    roots, arena = [], []

    def add(node):
        node.arena = len(arena)
        arena.append(node)

    for key in sorted(doc["roots"], key=str.encode):
        root = Node(doc["roots"][key] | {"type": "folder"}, 0, key, None)
        roots.append((key, root))
        add(root)
        for i, c in enumerate(doc["roots"][key].get("children", [])):
            top = Node(c, 1, f"{key}/{i}", root)
            root.children.append(top)
            add(top)
            todo = [top]
            while todo:
                node = todo.pop()
                block = [Node(x, node.depth + 1, f"{node.path}/{k}", node) for k, x in enumerate(node.get("children") or [])]
                node.children = block
                for x in reversed(block):
                    add(x)
                todo += reversed(block)
    return roots, arena


def number_first(s, missing_before_text):
    n = u64(s)
    if n is not None:
        return (0, n, "")
    if missing_before_text:
        return (1, 0, "") if s is None else (2, 0, s)
    return (1, 0, s) if s is not None else (2, 0, "")


def normalize(doc):
    """What stays, as {path: (parent path, position, visits, modified)}; counters; paths in arena order; the log."""
    roots, arena = build(doc)
    log = []
    gone = set()
    groups = {}
    for n in arena:
        if n.get("type") == "folder" and n.depth and n.get("name") is not None:
            groups.setdefault(trim(unicodedata.normalize("NFC", n.get("name"))).lower(), []).append(n)
    merged = 0
    for members in groups.values():
        members.sort(key=lambda n: (n.depth, (1 << 64) - 1 if u64(n.get("date_added")) is None else u64(n.get("date_added")), number_first(n.get("id"), True), (n.get("guid") is not None, n.get("guid") or ""), n.arena))
        members[0].members = members
        merged += len(members) - 1
    for key in sorted(groups, key=str.encode):
        if len(members := groups[key]) > 1:
            log.append({"type": "folder_merge_planned", "normalized_name": key, "group_size": len(members)})
            log.append({"type": "folder_merged", "normalized_name": key, "winner_path": members[0].path, "losers": [m.path for m in members[1:]]})
    moved = {}
    for members in groups.values():
        for m in members[1:]:
            moved[m] = members[0]
            gone.add(m)
    for members in groups.values():
        w = members[0]
        visits = [m.get("visit_count") for m in members if m.get("visit_count") is not None]
        if visits:
            w.given["visit_count"] = sum(visits)
        best = w
        for m in members[1:]:
            if (u64(m.get("date_modified")) or 0) > (u64(best.get("date_modified")) or 0):
                best = m
        w.given["date_modified"] = best.get("date_modified")
    for members in groups.values():
        w = members[0]
        w.children = [c for m in members for c in m.children]
        for c in w.children:
            c.parent = w
    for n in arena:
        n.children = [c for c in n.children if c not in gone]
    dropped = 0
    for n in arena:
        if n in gone or n.get("type") != "folder":
            continue
        best, seen = {}, {}
        for at, c in enumerate(n.children):
            if c.get("type") == "url" and c.get("url") is not None:
                rank = (-(c.get("visit_count") or 0), -(u64(c.get("date_last_used")) or 0), u64(c.get("date_added")) or 0, number_first(c.get("id"), False), at)
                k = canonical(c.get("url"))
                seen[k] = seen.get(k, 0) + 1
                if k not in best or rank < best[k][0]:
                    best[k] = (rank, c)
        keep = {id(c) for _, c in best.values()}
        left = [c for c in n.children if c.get("type") != "url" or c.get("url") is None or id(c) in keep]
        dropped += len(n.children) - len(left)
        log += [{"type": "url_deduped", "folder_path": n.path, "canonical_url": k, "removed": seen[k] - 1} for k in sorted(seen, key=str.encode) if seen[k] > 1]
        n.children = left
    pruned = 0

    def prune(n):
        nonlocal pruned
        for c in list(n.children):
            if c.get("type") == "folder":
                prune(c)
                if not c.children:
                    n.children.remove(c)
                    pruned += 1
                    log.append({"type": "folder_pruned", "folder_path": c.path})

    out = {}

    def order(n):
        def key(c):
            if c.get("type") == "folder":
                return (0, trim(c.get("name") or "").lower(), c.get("id") or "")
            if c.get("type") == "url":
                return (1, canonical(c.get("url") or ""), c.get("id") or "")
            return (2, c.get("type"), c.get("name") or "")

        n.children.sort(key=key)
        for i, c in enumerate(n.children):
            out[c.path] = (n.path, i, c.get("visit_count"), c.get("date_modified"))
            order(c)

    for i, (_, r) in enumerate(roots):
        prune(r)
        out[r.path] = (None, i, r.get("visit_count"), r.get("date_modified"))
        order(r)
    counts = {"folders_seen": sum(n.get("type") == "folder" for n in arena), "urls_seen": sum(n.get("type") == "url" for n in arena), "folders_merged": merged, "urls_deduped": dropped, "folders_pruned": pruned}
    names = [n.get("name") for n in arena if n.path in out and n.get("type") == "folder" and n.get("name") is not None]
    return out, counts, [n.path for n in arena], whole_log(log, counts, {k: names.count(k) for k in sorted(names, key=str.encode)})


def whole_log(steps, counts, registry):
    """The steps between the phases' starts and ends; scc_computed is left to the tests of components."""
    of = lambda *kinds: [e for e in steps if e["type"] in kinds]
    start, end = (lambda n: {"type": "phase_started", "name": n}), (lambda n: {"type": "phase_finished", "name": n})
    log = [start("parse_and_index"), end("parse_and_index"), start("scc"), end("scc"), start("folder_merge_iteration_1"), *of("folder_merge_planned", "folder_merged")]
    log += [start("per_folder_url_dedup"), *of("url_deduped"), end("per_folder_url_dedup"), start("prune_empty"), *of("folder_pruned"), end("prune_empty"), start("rebuild_check")]
    if registry:
        log.append({"type": "folder_counts", "counts": registry})
    return [*log, end("folder_merge_iteration_1_complete"), start("final_rebuild"), end("final_rebuild"), {"type": "finished", "stats": counts}]
