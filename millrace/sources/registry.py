"""Named corpora whose files sit below one root path or object-store prefix."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CorpusSource:
    name: str
    kind: str
    files: list[str]
    text_column: str
    extra_columns: list[str] = field(default_factory=list)
    known_counts: dict[str, int] = field(default_factory=dict)
    table: str | None = None

    def paths(self, root: str) -> list[str]:
        return [f"{root.rstrip('/')}/{name}" for name in self.files]


# Public corpora, their part names, text columns and known row counts.
SOURCES = {
    s.name: s
    for s in (
        CorpusSource(
            "ultrafineweb_zh",
            "parquet",
            [f"ultrafineweb_zh/ultrafineweb-zh-part-{i:03d}-of-256.parquet" for i in range(1, 12)],
            "content",
            extra_columns=["source"],
        ),
        CorpusSource(
            "cci4_zh",
            "jsonl",
            [f"zh_cc-high-loss0/{group:03d}_{part:05d}.jsonl" for group in (0, 1) for part in range(8)],
            "text",
            known_counts={"000_00000.jsonl": 460_860},
        ),
        CorpusSource(
            "nemotron_cc_math_4plus",
            "parquet",
            [f"4plus/part_{i:06d}.parquet" for i in range(46)],
            "text",
        ),
    )
}


def source(name: str) -> CorpusSource:
    if name not in SOURCES:
        raise ValueError(f"unknown source: {name}")
    return SOURCES[name]
