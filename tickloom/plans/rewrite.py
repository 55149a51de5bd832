"""Rewrites of a pipeline before Catalyst sees it."""

from __future__ import annotations

from tickloom.plans.tree import Chain, Fused, Node, Split, Tumbling, Vector, Worker


def flatten(stages: tuple[Node, ...]) -> tuple[Node, ...]:
    """Chains are their stages; a split by symbol is its child, since every operator keeps symbols apart, and accessors below it know that they read each value's."""
    out: list[Node] = []
    for node in stages:
        if isinstance(node, Chain):
            out += flatten(node.stages)
        elif isinstance(node, Split):
            out += flatten((node.child,))
        else:
            out.append(node)
    return tuple(out)


def fold_scales(stages: tuple[Node, ...]) -> tuple[Node, ...]:
    """Neighbouring scale Workers are one: they look at the last value alone."""
    out: list[Node] = []
    for node in stages:
        before = out[-1] if out else None
        if isinstance(node, Worker) and isinstance(before, Worker) and node.fn == before.fn == "scale":
            factor = dict(before.parameters).get("factor", 1.0) * dict(node.parameters).get("factor", 1.0)
            out[-1] = Worker("scale", (("factor", factor),))
        else:
            out.append(node)
    return tuple(out)


def fuse_windows(stages: tuple[Node, ...]) -> tuple[Node, ...]:
    """A tumbling window and the reducer behind it are one grouped aggregate, so no vector is built."""
    out: list[Node] = []
    for node in stages:
        if isinstance(node, Vector) and out and isinstance(out[-1], Tumbling):
            out[-1] = Fused(out[-1].period_ms, node.fn)
        else:
            out.append(node)
    return tuple(out)


def rewrite(stages: tuple[Node, ...]) -> tuple[Node, ...]:
    return fuse_windows(fold_scales(flatten(stages)))
