"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make sure that Python workers can import this package: where they do
    not find it by themselves, it is sent to them as an archive. Once a session."""
    context = spark.sparkContext
    if getattr(context, "_symloom_shipped", False):
        return

    def there(_: int) -> bool:  # refers to nothing of this package, so that it travels by value
        import importlib.util

        return importlib.util.find_spec("symloom") is not None

    parts = context.defaultParallelism
    if not all(context.parallelize(range(parts), parts).map(there).collect()):
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="symloom-")) / "symloom.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*")):
                if path.suffix in (".py", ".toml"):
                    z.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
    context._symloom_shipped = True
