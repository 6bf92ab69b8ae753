"""Relational operators over detections, tracklets, events and review logs."""
