"""Stack fusion on Spark: focus-bracketed images as relations and as frames."""

__version__ = "0.2.0"

from .demo import stack, stack_streaming
from .functions.kernels import expand, reduce, region_deviation, region_energy, region_entropy
from .operators.fusion import level_count
from .plans.run import (
    CullEntry,
    CullResult,
    FocusStackConfig,
    Interrupted,
    RunResult,
    align_images,
    compute_canvas,
    cull_unfocused_images,
    load_images,
    resolve_images,
    run,
    slab_images,
    stack_images,
)
from .sources.tables import EXTENSIONS as IMAGE_EXTENSIONS
from .streaming.incremental import PreviewCallback, StreamingFocusStacker


def compute_levels(shape: tuple[int, ...], max_levels: int = 6) -> int:
    return level_count(*shape[:2], max_levels)


__all__ = [
    "IMAGE_EXTENSIONS",
    "CullEntry",
    "CullResult",
    "FocusStackConfig",
    "Interrupted",
    "PreviewCallback",
    "RunResult",
    "StreamingFocusStacker",
    "align_images",
    "compute_canvas",
    "compute_levels",
    "cull_unfocused_images",
    "expand",
    "load_images",
    "reduce",
    "region_deviation",
    "region_energy",
    "region_entropy",
    "resolve_images",
    "run",
    "slab_images",
    "stack",
    "stack_images",
    "stack_streaming",
]
