"""tractlens: Spark-native mortgage-lending analytics (tract scores, YoY,
forecast inputs, segmentation, application features and models)."""

__version__ = "0.1.0"
