"""Spark jobs over the packet, frame, segment, job and node tables of a video-processing fleet."""
