"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

#: Events as sample streams: stream, order, seconds, signal.
EVENTS = """e AS (
  SELECT event_id, user_id, event_type, value::DOUBLE AS value, epoch_us(ts) AS us, epoch_us(ts) / 1000000.0::DOUBLE AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""

#: Embeddings as a raster: a row of pixels for each vec_id, as doubles.
RASTER = """src AS (SELECT vec_id AS y, list_transform(embedding, lambda v: v::DOUBLE) AS r FROM embeddings),
px AS (SELECT y, unnest(range(0, 64)) AS x FROM src)"""


def mirrored(v: str, n: str) -> str:
    """A position reflected once about the first or last sample."""
    return f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} >= {n} THEN 2 * {n} - 2 - ({v}) ELSE {v} END)"


def clamped(v: str, n: str) -> str:
    return f"least(greatest({v}, 0), {n} - 1)"


class Stencil:
    """Writes one CTE per kernel: planes are rows of lists, neighbours are joined by their row.

    ``edge`` maps a position beyond the picture into it.
    """

    def __init__(self, edge=mirrored) -> None:
        self.edge = edge
        self.ctes: list[str] = []
        self.used: set[tuple[str, int]] = set()

    def at(self, plane: str, dx: int = 0, dy: int = 0) -> str:
        self.used.add((plane, dy))
        return f"{plane}_{'m' if dy < 0 else 'p'}{abs(dy)}.r[{self.edge(f'(x + {dx})', '64')} + 1]"

    def stage(self, name: str, expression: str) -> None:
        joins = " ".join(
            f"JOIN {p} AS {p}_{'m' if d < 0 else 'p'}{abs(d)} ON {p}_{'m' if d < 0 else 'p'}{abs(d)}.y = {self.edge(f'(px.y + {d})', 'size.n')}"
            for p, d in sorted(self.used))
        self.ctes.append(f"{name} AS MATERIALIZED (SELECT px.y AS y, list_transform(range(0, 64), lambda x: {expression}) AS r FROM (SELECT y FROM src) px CROSS JOIN (SELECT count(*) AS n FROM src) size {joins})")
        self.used = set()

    def sql(self, select: str) -> str:
        return "WITH " + ",\n".join([RASTER, *self.ctes]) + "\n" + select


def pixels(plane: str, digits: int = 6) -> str:
    """Select every pixel of a plane, rounded."""
    return f"SELECT y, x, round(v, {digits}) AS v FROM (SELECT y, unnest(range(0, 64)) AS x, unnest(r) AS v FROM {plane})"
