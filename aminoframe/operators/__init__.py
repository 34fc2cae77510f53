"""The descriptors; importing this registers all of them."""

from . import complexity, composition, ctd, motif, physicochemical, positional, sequence
from .base import REGISTRY, Descriptor, register

__all__ = ["REGISTRY", "Descriptor", "complexity", "composition", "ctd", "motif", "physicochemical", "positional", "register", "sequence"]
