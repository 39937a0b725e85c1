"""Part of tessera: plans."""
