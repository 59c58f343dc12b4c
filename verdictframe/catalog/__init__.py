"""Named queries over the driver's tables, each with its SQL twin."""

from importlib import import_module

_MODULES = (
    "metrics", "rows", "generate", "intervals", "gates", "documents", "integrity",
    "ratings", "lifecycle", "study", "agreement", "sources", "streams", "plans",
)


def load_all() -> None:
    """Import every catalog module so that its queries register."""
    for name in _MODULES:
        try:
            import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"{__name__}.{name}":
                raise
