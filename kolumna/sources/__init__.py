"""Where rows come from and go to: stored tables, attached files, generators."""

from kolumna.sources.catalog import Catalog
from kolumna.sources.generators import bench_table, goods_table, scan_table

__all__ = ["Catalog", "bench_table", "goods_table", "scan_table"]
