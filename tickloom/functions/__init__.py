from tickloom.functions.basis import ArrayBasis, Basis, ColumnBasis, FrameBasis, GroupBasis, NotedBasis
from tickloom.functions.builtin import EPSILON, FUNCTIONS, PARAMETRIC, PLAIN, FunctionRegistry

__all__ = ["ArrayBasis", "Basis", "ColumnBasis", "EPSILON", "FUNCTIONS", "FrameBasis", "FunctionRegistry", "GroupBasis", "NotedBasis", "PARAMETRIC", "PLAIN"]
