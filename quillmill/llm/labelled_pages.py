"""Pages written by hand in the manner of common layouts, with their main content marked by the attribute ``data-y``.

They do not take their names of classes from the lists that make the features: most are frameworks' names that say
little, and some mislead. Each page stands for a layout of its own, so one can be held out.
"""

#: Layout: page. Every element of the main content is marked.
PAGES = {
    "newspaper": """<html><head><title>Bridge</title></head><body class="tpl-3"><div class="u-strip"><a href="/">The Daily Wharf</a> <a href="/s">Subscribe</a></div>
<nav class="c-primary"><ul><li><a href="/w">World</a></li><li><a href="/l">Local</a></li><li><a href="/o">Opinion</a></li></ul></nav>
<div class="l-grid" data-y><article class="c-piece" data-y><h1 data-y>Bridge over the Tarn reopens</h1><p class="standfirst" data-y>After three years of work the crossing is free of scaffolding.</p>
<div class="byline-row" data-y><p data-y>By Mira Holt, 4 May</p></div><p data-y>Traffic returned on Monday morning, and with it the bakers' vans that used to queue here at six.</p>
<aside class="c-rel"><h4>More on this</h4><ul><li><a href="/1">Tolls rise</a></li><li><a href="/2">Ferry sold</a></li></ul></aside>
<p data-y>The council put the cost at nine million, two more than planned.</p><blockquote data-y>It was worth the wait, said the mayor.</blockquote><div class="mpu">Advertisement <a href="/x">Visit Spain</a></div>
<p data-y>Work on the footpath goes on until autumn.</p></article></div><section class="c-talk comments"><h3>Have your say</h3><div><b>tom</b><p>About time too, I crossed it as a child.</p></div></section>
<footer><p>Wharf Media Ltd. All rights reserved.</p></footer></body></html>""",
    "blog": """<html><body><div id="wrap"><div id="hd" role="banner"><h1><a href="/">Salt and Rye</a></h1><p>Notes from a small kitchen</p></div>
<div id="bd" data-y><div class="hentry" data-y><h2 data-y>A loaf for lazy people</h2><div class="body-copy" data-y><p data-y>Mix at night, bake at noon. That is all.</p><ul data-y><li data-y>500 g of flour</li><li data-y>10 g of salt</li><li data-y>350 g of water</li></ul>
<p data-y>Leave it alone for twelve hours. It does not need you.</p><pre data-y>230 degrees, 40 minutes</pre></div><div class="sharedaddy"><a href="#">Tweet</a> <a href="#">Pin it</a></div></div>
<ol class="commentlist"><li class="even"><cite>Ana</cite><p>Made it twice already and my family loves it.</p></li><li class="odd"><cite>Jo</cite><p>Mine was flat.</p></li></ol></div>
<div id="rail" class="widget-area"><h3>About me</h3><p>I bake and I write about it on slow days.</p><h3>Archives</h3><ul><li><a href="/5">May</a></li></ul></div><div id="ft" role="contentinfo">Powered by a blog engine</div></div></body></html>""",
    "manual": """<html><body><header class="md-top"><a href="/">libpool 2.1</a><form><input name="q" placeholder="Search"></form></header><div class="md-cols"><div class="md-left"><nav><ul><li><a href="/a">Install</a></li><li><a href="/b">Pools</a></li><li><a href="/c">Limits</a></li></ul></nav></div>
<main class="md-mid" data-y><h1 data-y>Pools</h1><p data-y>A pool keeps connections open and lends them out.</p><h2 data-y>Create one</h2><pre data-y><code>pool = Pool(size=4)</code></pre><p data-y>The size is the most that are open at once.</p>
<table data-y><tr data-y><th data-y>Option</th><th data-y>Default</th></tr><tr data-y><td data-y>size</td><td data-y>4</td></tr><tr data-y><td data-y>wait</td><td data-y>30 s</td></tr></table><dl data-y><dt data-y>wait</dt><dd data-y>How long a caller waits for a free one.</dd></dl>
<div class="md-pn"><nav><a href="/a">Previous: Install</a> <a href="/c">Next: Limits</a></nav></div></main><div class="md-right sidebar"><p>On this page</p><ul><li><a href="#c">Create one</a></li></ul></div></div><footer>Made with care</footer></body></html>""",
    "old": """<html><body bgcolor="#ffffff"><table width="100%"><tr><td colspan="2"><div class="logo">Hill Walkers' Club</div></td></tr><tr><td><div class="menu"><a href="a.htm">Home</a><br><a href="b.htm">Walks</a><br><a href="c.htm">Join us</a></div></td></tr></table>
<div data-y><h1 data-y>Round the reservoir</h1><p data-y>Six miles, mostly level, with one stile that is slippery after rain.</p><p data-y>Park at the dam. Cross the road and take the track by the wall.<p data-y>Dogs on leads, please.</div>
<div class="copyright"><hr>Last changed 3 June 2003</div></body></html>""",
    "shop": """<html><body><div class="promo-strip promo">Free delivery today only</div><header><a href="/">Tool Barn</a><nav><a href="/h">Hammers</a><a href="/d">Drills</a></nav></header><div class="breadcrumb"><a href="/">Home</a> / <a href="/d">Drills</a></div>
<main data-y><section class="pdp" data-y><h1 data-y>Cordless drill 18 V</h1><p data-y>A light drill for shelves and sheds.</p><ul data-y><li data-y>Two speeds</li><li data-y>Weighs 1.2 kg</li></ul><form><label>Quantity</label><input><button>Add to basket</button></form><p data-y>Comes with one battery and a case.</p></section></main>
<section class="reviews"><h2>Reviews</h2><article><p>Does what it says on the box and no more.</p></article><article><p>Battery died after a year.</p></article></section><aside class="related"><h2>You may also like</h2><a href="/1">Bits</a><a href="/2">Saws</a></aside><footer class="site-footer"><ul><li><a href="/r">Returns</a></li></ul></footer></body></html>""",
    "encyclopedia": """<html><body><div class="mw-jump"><a class="skip" href="#c">Skip to text</a></div><div id="mw-head" class="header"><a href="/l">Log in</a></div><div id="mw-panel" class="navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li></ul></div>
<div id="c" class="mw-body" data-y><h1 data-y>Lime kiln</h1><div class="toc"><h2>Contents</h2><ul><li><a href="#1">Use</a></li></ul></div><p data-y>A <a href="/k">kiln</a> in which <a href="/l">limestone</a> is burnt to quicklime.</p><h2 data-y>Use</h2><p data-y>Farmers spread the lime on sour fields; builders slaked it for mortar.</p>
<figure data-y><img src="k.jpg"><figcaption data-y>A kiln at Crook</figcaption></figure><ul data-y><li data-y>Draw kilns burn all the time.</li><li data-y>Flare kilns burn once.</li></ul></div><div id="footer" class="footer"><p>Text is free to use under a licence.</p></div></body></html>""",
    "app": """<html><body><div id="root"><div class="css-1a2b"><div class="css-nav nav"><a href="/">Pulse</a><button>Sign in</button></div><div class="css-9z" data-y><div class="css-77" data-y><div class="css-t" data-y><h1 data-y>Why our queue was slow</h1></div><div class="css-p" data-y><p data-y>Every job took a lock that none of them needed.</p></div>
<div class="css-p" data-y><p data-y>We removed it, and the tail went from nine seconds to one.</p><p data-y>Here is how we found it.</p></div></div><div class="css-s share"><button>Share</button><span class="css-c">12</span></div></div><div class="cookie-bar cookie"><p>We use cookies to make this site work better for you.</p><button>Accept</button></div></div></div><script>boot()</script></body></html>""",
    "forumless": """<html><body><header role="banner"><h1>Parish news</h1></header><div class="alert alert-info"><p>The office is closed on Friday.</p></div><div class="container" data-y><div class="row" data-y><div class="col-8" data-y><header data-y><h2 data-y>Harvest supper</h2></header><p data-y>Supper is at seven in the hall. Bring a dish and a chair.</p>
<p data-y>There will be a raffle for the roof.</p><section data-y><h3 data-y>Who to ask</h3><p data-y>Speak to Joan after the service or leave a note at the shop.</p></section></div></div></div><div class="col-4 sidebar"><h4>Services</h4><p>Sunday at ten, and the second Wednesday of the month at noon.</p></div><div class="newsletter"><form><p>Sign up for our letter</p><input><button>Go</button></form></div><footer><p>Registered charity</p></footer></body></html>""",
}
