"""Column functions: images as arrays of pixels, boxes and distances. All run inside the JVM."""
