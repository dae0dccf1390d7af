"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "sawmill", **conf: str) -> SparkSession:
    """UTC, adaptive execution; other settings are the cluster's own."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes sure that Python workers can import this package: where the driver's PYTHONPATH doesn't name its folder, a zip
    of it goes to the executors, once a session."""
    import os
    import tempfile
    import zipfile

    package = os.path.dirname(os.path.abspath(__file__))
    root, context = os.path.dirname(package), spark.sparkContext
    named = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in named or getattr(context, "_sawmill_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="sawmill-"), "sawmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._sawmill_shipped = True
    return spark
