"""The per-document PDF reader: plain Python, no Spark. Everything Catalyst can say stays outside."""
