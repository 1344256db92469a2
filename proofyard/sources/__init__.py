"""Reading and writing: log tables, byte stores, tiles, feeds."""
