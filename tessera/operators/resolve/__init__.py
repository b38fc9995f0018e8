"""What the files of one workspace say, replayed and combined: tables, and the links that are declared between them."""

from tessera.operators.resolve.link import settle

__all__ = ["settle"]
