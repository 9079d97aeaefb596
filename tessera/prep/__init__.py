"""Preprocessors whose state is plain JSON and whose transform is column expressions."""

from tessera.prep.tabular import TabularPreprocessor, TabularState, WoePreprocessor

__all__ = ["TabularPreprocessor", "TabularState", "WoePreprocessor"]
