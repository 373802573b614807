"""folioscope: catalogue and corpus analytics as pure DataFrame functions on Spark."""
