"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from labelprism.functions.columns import *  # noqa: F401,F403
