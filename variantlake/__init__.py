"""variantlake: math-problem variant datasets and answer grading on Spark."""
__version__ = "0.1.0"
