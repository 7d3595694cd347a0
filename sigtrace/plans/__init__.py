"""End-to-end plans: the query catalogue over the bound evidence tables."""

from importlib import import_module

MODULES = ("board", "schematic", "page", "combined", "files")


def load():
    """Import every plan module and return the catalogue they fill."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.catalogue")
