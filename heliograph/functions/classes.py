"""What kind a Java class is, as Spark columns; every list can be extended by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import _col

#: Names and prefixes that tell classes apart.
PRIMITIVE_ARRAYS = ["byte[]", "char[]", "int[]", "long[]", "short[]", "boolean[]", "float[]", "double[]"]
JDK_PREFIXES = ["java.lang.", "java.util.", "java.io.", "java.nio.", "java.net.", "java.security.", "java.math.", "java.text.", "java.time.", "java.sql.", "java.reflect.", "javax.", "sun.", "com.sun.", "jdk."]
FRAMEWORK_PREFIXES = [
    "org.springframework.aop.framework.", "org.springframework.beans.factory.support.", "org.springframework.context.annotation.ConfigurationClassParser",
    "org.springframework.core.annotation.AnnotationUtils", "org.springframework.util.ConcurrentReferenceHashMap", "io.netty.buffer.PoolArena", "io.netty.buffer.PoolChunk",
    "io.netty.buffer.PoolSubpage", "io.netty.buffer.PoolThreadCache", "io.netty.util.internal.", "io.netty.util.Recycler", "com.google.common.collect.",
    "com.google.common.cache.", "org.slf4j.impl.", "ch.qos.logback.core.", "ch.qos.logback.classic.spi.", "com.fasterxml.jackson.core.json.",
    "com.fasterxml.jackson.databind.cfg.", "com.fasterxml.jackson.databind.introspect.", "net.bytebuddy.description.", "net.bytebuddy.pool.", "net.bytebuddy.dynamic.",
    "io.opentelemetry.javaagent.tooling.", "io.opentelemetry.javaagent.shaded.", "io.opentelemetry.javaagent.bootstrap.", "com.alibaba.arthas.deps.",
]
TOP_LEVEL_EXACT = [
    *PRIMITIVE_ARRAYS, "java.lang.Object[]", "java.lang.String[]", "java.lang.Class", "java.util.HashMap$Node", "java.util.HashMap$Node[]", "java.util.HashMap$TreeNode",
    "java.util.HashSet$Node", "java.util.concurrent.ConcurrentHashMap$Node", "java.util.concurrent.ConcurrentHashMap$Node[]", "java.util.ArrayList", "java.util.LinkedList",
    "java.util.HashMap", "java.util.LinkedHashMap", "java.util.TreeMap", "java.util.HashSet", "java.util.LinkedHashSet", "java.util.TreeSet",
    "java.util.concurrent.ConcurrentHashMap", "java.util.concurrent.CopyOnWriteArrayList",
]
TOP_LEVEL_PREFIXES, TOP_LEVEL_SUFFIXES, TOP_LEVEL_PARTS = ["jdk.proxy", "com.sun.proxy"], ["Allocator", "ByteBufAllocator"], ["$$Lambda"]
COLLECTIONS = [
    "java.util.ArrayList", "java.util.LinkedList", "java.util.HashMap", "java.util.LinkedHashMap", "java.util.HashSet", "java.util.LinkedHashSet", "java.util.TreeMap",
    "java.util.TreeSet", "java.util.concurrent.ConcurrentHashMap", "java.util.IdentityHashMap", "java.util.WeakHashMap", "java.util.Vector", "java.util.Stack",
]
LEAK_PARTS = ["HashMap", "ArrayList", "LinkedList", "HashSet", "ConcurrentHashMap", "LinkedHashMap", "TreeMap", "WeakHashMap", "IdentityHashMap"]
ROOT_PARTS = ["java.lang.Thread", "java.lang.Class", "java.lang.ClassLoader", "JNI Global", "System Class", "Thread Block", "Busy Monitor", "Native Stack", "Finalizer"]
UI_JDK_PREFIXES = ["java.", "javax.", "sun.", "jdk.", "com.sun."]
UI_FRAMEWORK_PREFIXES = [
    "org.springframework.aop.", "org.springframework.beans.factory.support.", "io.netty.buffer.Pool", "io.netty.util.internal.", "io.netty.util.Recycler",
    "com.google.common.collect.", "com.google.common.cache.", "org.slf4j.", "ch.qos.logback.", "com.fasterxml.jackson.core.", "com.fasterxml.jackson.databind.cfg.",
    "net.bytebuddy.", "io.opentelemetry.javaagent.",
]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def class_category(name: Column | str, jdk: list[str] = JDK_PREFIXES, framework: list[str] = FRAMEWORK_PREFIXES, business: list[str] = ()) -> Column:
    """primitive, jdk, framework, business or application; the first that fits. Without a name, unknown."""
    name = _col(name)
    begins = lambda prefixes: _any([name.startswith(p) for p in prefixes])
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(name.isin(PRIMITIVE_ARRAYS), "primitive").when(name.endswith("[]") | begins(jdk), "jdk").when(begins(framework), "framework").when(begins(business), "business").otherwise("application")
    )


def is_business(name: Column | str) -> Column:
    return class_category(name).isin("application", "business")


def is_top_level_filtered(name: Column | str, exact: list[str] = TOP_LEVEL_EXACT, prefixes: list[str] = TOP_LEVEL_PREFIXES, suffixes: list[str] = TOP_LEVEL_SUFFIXES, parts: list[str] = TOP_LEVEL_PARTS) -> Column:
    """Containers, proxies and the like that lists of the biggest objects leave out."""
    name = _col(name)
    return name.isin(exact) | _any([name.startswith(p) for p in prefixes]) | _any([name.endswith(p) for p in suffixes]) | _any([name.contains(p) for p in parts])


def is_collection(name: Column | str) -> Column:
    return _col(name).isin(COLLECTIONS)


def may_leak(name: Column | str) -> Column:
    return _any([_col(name).contains(p) for p in LEAK_PARTS])


def is_root_class(name: Column | str) -> Column:
    return _any([_col(name).contains(p) for p in ROOT_PARTS])


def is_business_in_views(name: Column | str, frameworks: bool = False) -> Column:
    """The views' simpler test: no JDK class, no array, and with frameworks no framework's class."""
    name = _col(name)
    prefixes = UI_JDK_PREFIXES + (UI_FRAMEWORK_PREFIXES if frameworks else [])
    return (F.coalesce(name, F.lit("")) != "") & ~name.contains("[]") & ~_any([name.startswith(p) for p in prefixes])
