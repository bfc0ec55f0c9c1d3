"""The coder's steps as functions of the session (``IdCoder.java``), which run in the executors' JVMs.

``id_coder`` is the same coder by arrays, for use without a session; both give the same bytes. Each id of a block depends on the
one before, so arrays can only take a step of many blocks at once, which costs several times as much.

The source is compiled in the driver by Janino, which Spark has for the code that it generates, and goes to the executors as a jar of
the application. The jar lies in a temporary folder of the driver, which goes when the driver's Python process ends.
"""

from __future__ import annotations

import atexit
import os
import pkgutil
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACK, UNPACK = "parcelyze_pack_ids", "parcelyze_unpack_ids"
_UNPACKED = "array<struct<doc_id: bigint, inner: bigint, n_tokens: bigint, ids_crc32: bigint>>"
_loaders: dict[str, object] = {}


def _loader(spark: SparkSession):
    """The class loader of the compiled classes, which the application's executors get, too."""
    app = spark.sparkContext.applicationId
    if app not in _loaders:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(pkgutil.get_data(__package__, "IdCoder.java").decode())
        folder = os.path.realpath(tempfile.mkdtemp(prefix="id-coder-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"id-coder-{app}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", code)
        spark.sparkContext._jsc.addJar(path)
        _loaders[app] = compiler.getClassLoader()
    return _loaders[app]


def register(spark: SparkSession) -> None:
    """Makes ``PACK`` (a segment's head and ids to its bytes) and ``UNPACK`` (its bytes to rows of its documents) known to the session."""
    new_array, java = spark.sparkContext._gateway.new_array, spark._jvm.java.lang
    loader = _loader(spark)
    for name, kind, result in ((PACK, "Pack", "binary"), (UNPACK, "Unpack", _UNPACKED)):
        if spark.catalog.functionExists(name):
            continue
        made = loader.loadClass(f"parcelyze.llm.IdCoder${kind}").getDeclaredConstructor(new_array(java.Class, 0)).newInstance(new_array(java.Object, 0))
        spark._jsparkSession.udf().register(name, made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(result))
