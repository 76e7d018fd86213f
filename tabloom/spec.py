"""What a table of labelled measurements looks like: columns, allowed labels and cleaning rules."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """numeric: columns in order; ratios lie in (0, 1]; caps: largest values; at_most: (a, b) with a <= b."""

    numeric: tuple[str, ...]
    labels: tuple[str, ...]
    label: str = "class"
    repair_sign: tuple[str, ...] = ()
    ratios: tuple[str, ...] = ()
    caps: dict[str, float] = field(default_factory=dict)
    at_most: tuple[tuple[str, str], ...] = ()


#: The preset of sixteen shape measurements and seven classes.
SHAPES = TableSpec(
    numeric=(
        "Area", "Perimeter", "MajorAxisLength", "MinorAxisLength", "AspectRation", "Eccentricity", "ConvexArea", "EquivDiameter",
        "Extent", "Solidity", "roundness", "Compactness", "ShapeFactor1", "ShapeFactor2", "ShapeFactor3", "ShapeFactor4",
    ),
    labels=("BARBUNYA", "BOMBAY", "CALI", "DERMASON", "HOROZ", "SEKER", "SIRA"),
    label="Class",
    repair_sign=("Area",),
    ratios=("Eccentricity", "Extent", "Solidity", "roundness", "Compactness", "ShapeFactor3", "ShapeFactor4"),
    caps={"MajorAxisLength": 1000.0},
    at_most=(("Area", "ConvexArea"),),
)
#: Columns that also get a logarithm.
LOG_COLUMNS = ("Area", "Perimeter", "MajorAxisLength", "MinorAxisLength", "ConvexArea", "EquivDiameter")
