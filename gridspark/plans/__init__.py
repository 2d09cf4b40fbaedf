"""From formulas to plans: the compiler and the workbook planner."""
