"""DataFrame operators of the layers, alerts, reports, latest values and models."""
