"""Training-data operators. Nothing else in keelson imports this subpackage."""
